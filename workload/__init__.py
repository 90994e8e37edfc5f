"""Registered queries: library operators run on panels derived from the driver's tables."""
