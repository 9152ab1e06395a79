"""Comparison semantics and aggregate functions of the dialect."""
