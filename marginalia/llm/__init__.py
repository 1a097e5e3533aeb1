"""Operators for training-data corpora. Nothing outside this folder imports it."""
