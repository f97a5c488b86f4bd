"""Detects, redacts and restores personal data in columns of text, on Spark."""
