"""Spatial territory analytics on Spark DataFrames."""
