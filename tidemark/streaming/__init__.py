"""Incremental versions of the vintage and accuracy tables."""
