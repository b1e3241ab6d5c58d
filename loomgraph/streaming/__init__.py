"""Structured Streaming wrappers around the incremental operators."""
