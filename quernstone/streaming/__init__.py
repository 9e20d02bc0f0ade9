"""Structured Streaming wrappers of the change feed."""
