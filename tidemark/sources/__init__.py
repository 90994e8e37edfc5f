"""Readers, writers and the catalogue of stored results."""
