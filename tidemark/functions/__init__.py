"""Column-level vocabulary used by the operators."""
