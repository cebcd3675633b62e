"""Structured Streaming forms: file ingest, event-time windows and stateful limits."""
