"""Reading and writing: texts, mapping stores, run records, messages."""
