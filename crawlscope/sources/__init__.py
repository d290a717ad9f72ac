"""Readers, writers and the inputs derived from given tables."""
