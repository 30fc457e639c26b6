"""Readers and writers of fingerprint records, and the video catalogue."""
