"""Incremental re-validation with Structured Streaming."""
