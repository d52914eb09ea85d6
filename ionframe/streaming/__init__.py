"""Streams of scans and events."""
