"""Structured Streaming jobs (U2 incremental update)."""
