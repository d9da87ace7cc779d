"""Incremental ingest, running counts and incremental matching."""
