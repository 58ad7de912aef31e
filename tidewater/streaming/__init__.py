"""Incremental file ingest with Structured Streaming (L1)."""
