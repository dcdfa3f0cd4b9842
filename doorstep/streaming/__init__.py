"""Structured Streaming variants of the point-in-time and maturation operators."""
