"""Scans, dimensions and sinks."""
