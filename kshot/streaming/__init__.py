"""Structured Streaming variants of classification and metrics (K1, K2)."""
