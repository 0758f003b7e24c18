"""Versioned collections of nested records, queried and maintained with Spark DataFrames."""

__version__ = "0.1.0"
