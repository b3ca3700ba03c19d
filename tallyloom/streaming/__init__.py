"""Structured Streaming over statement files and event tables."""
