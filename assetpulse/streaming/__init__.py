"""Structured Streaming forms of the ingest, grid, event and offline rules."""
