"""Ordered per-symbol series on Spark: lookups, scans, merges, and a versioned store."""

__version__ = "0.1.0"
