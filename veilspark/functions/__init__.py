"""Column functions: patterns, spans, validators, synthetic values, triage signals."""
