"""Numeric functions that Spark lacks."""
