"""Structured Streaming forms of operators that gather items."""
