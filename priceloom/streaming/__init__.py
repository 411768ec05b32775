"""Arriving extracts with Structured Streaming."""
