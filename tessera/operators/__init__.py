"""Relational operators expressed as DataFrame transformations."""
