"""Operators for large training-data pipelines; nothing outside this package imports it."""
