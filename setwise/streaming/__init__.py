"""Incremental builders on Structured Streaming."""
