"""Catalog and signal-quality analytics on PySpark."""
