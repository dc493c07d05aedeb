"""Tessella: hybrid retrieval, issue analytics and text processing as PySpark plans."""

__version__ = "0.1.0"
