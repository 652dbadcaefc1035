"""Whole flows, and the registered queries with their SQL counterparts."""
