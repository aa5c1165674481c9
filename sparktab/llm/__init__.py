"""Operators for training text: scoring, cleaning, decontamination, encoding, extraction and duplicates."""
