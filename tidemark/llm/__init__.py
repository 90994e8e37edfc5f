"""Operators for preparing text corpora: counting, encoding, filtering, de-duplicating, sharding and packing."""
