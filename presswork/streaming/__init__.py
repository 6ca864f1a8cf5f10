"""Structured Streaming over engagement, fetch and stage events."""
