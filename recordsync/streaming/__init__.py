"""Structured Streaming twins of the change-log operators."""
