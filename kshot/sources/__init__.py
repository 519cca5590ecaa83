"""Readers and writers for the file layouts few-shot data arrives in."""
