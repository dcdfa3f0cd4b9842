"""Readers, writers, load checks and the canonical model over the driver tables."""
