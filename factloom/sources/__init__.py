"""Scans of raw records into facts, and sinks."""
