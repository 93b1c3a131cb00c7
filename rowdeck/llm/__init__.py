"""Operators for training-data corpora, their queries and SQL; nothing outside uses this package."""
