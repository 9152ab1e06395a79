"""Operators for preparing training text: deduplication, filtering, tokenizing, mixing, search and chat data."""
