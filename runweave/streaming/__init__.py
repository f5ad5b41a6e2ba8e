"""Structured Streaming forms of ingest, alerts and trends."""
