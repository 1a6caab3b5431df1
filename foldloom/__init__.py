"""Fold-aware time-series analytics on Spark."""
