"""Structural search, rewrite and text processing over collections of documents, on Spark."""
