"""Structured Streaming jobs and their shared pieces."""
