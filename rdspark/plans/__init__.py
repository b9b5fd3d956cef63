"""Composed plans, and the named queries that run them on the given tables."""
