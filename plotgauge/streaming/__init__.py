"""Incremental evaluation on Structured Streaming."""
