"""Readers, gates, raw-text parsing and sinks."""
