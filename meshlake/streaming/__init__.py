"""Incremental versions of the diagnostics on Structured Streaming."""
