"""Incremental ingest with Structured Streaming."""
