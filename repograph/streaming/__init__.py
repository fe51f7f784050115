"""Structured Streaming over job events."""
