"""Finds, masks, pseudonymises and restores personal data, and prepares texts for training, on Spark."""
