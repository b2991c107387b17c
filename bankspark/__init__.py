"""Retail-bank product-lifecycle analytics on PySpark."""

__version__ = "0.1.0"
