"""Structured Streaming forms of the operators that watch events as they come."""
