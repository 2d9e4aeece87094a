"""Spark-first engine for building, auditing and querying document corpora."""

__version__ = "0.1.0"
