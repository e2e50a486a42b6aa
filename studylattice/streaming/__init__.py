"""Structured Streaming views of the attempt log."""
