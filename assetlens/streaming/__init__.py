"""Incremental forms of batch operators (file streams)."""
