"""Structured Streaming forms of the review operators."""
