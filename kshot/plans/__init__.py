"""Composed plans: fixture frames over the given tables, the flagship evaluation, query catalog."""
