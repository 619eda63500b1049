"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports from it, so the rest of the package works without it.
"""
