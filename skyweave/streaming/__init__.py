"""Incremental accumulators for Structured Streaming."""
