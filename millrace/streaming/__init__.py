"""Structured Streaming forms of the load operators."""
