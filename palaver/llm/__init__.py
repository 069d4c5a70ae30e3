"""Operators for preparing training text: quality, personal data, toxicity, duplicates, mixing, tokens."""
