"""Incremental ingest of fingerprint records."""
