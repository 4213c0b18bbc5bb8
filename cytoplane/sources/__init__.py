"""Scans, sinks and the element catalogue."""
