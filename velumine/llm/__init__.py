"""Operators for text corpora and vector collections. Nothing outside this package imports it."""
