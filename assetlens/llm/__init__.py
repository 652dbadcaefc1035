"""Operators for training-data pipelines: search, de-duplication, quality, packing, formatting, tokens, licences."""
