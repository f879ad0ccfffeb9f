"""Matrices, ground truth, indexes and results in and out of storage."""
