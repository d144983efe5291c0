"""Curves that arrive bit by bit, as Structured Streaming queries."""
