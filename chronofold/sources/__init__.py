"""Scans of raw documents and versioned table sinks."""
