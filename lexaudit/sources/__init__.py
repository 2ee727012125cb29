"""Readers, writers and inputs derived from the driver tables."""
