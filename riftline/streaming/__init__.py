"""Structured Streaming forms of the scorers."""
