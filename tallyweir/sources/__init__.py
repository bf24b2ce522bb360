"""Readers, writers, table schemas and in-memory lookup tables."""
