"""Sparse-vector retrieval analytics on PySpark."""
