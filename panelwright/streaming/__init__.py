"""Structured Streaming forms of the point-in-time operators."""
