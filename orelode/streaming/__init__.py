"""Structured Streaming variants of the stream operators."""
