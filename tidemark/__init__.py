"""Vintage panels, news decomposition and nowcast evaluation as Spark DataFrame operators."""
