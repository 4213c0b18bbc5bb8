"""Incremental counts and ingest of arriving transcript files."""
