"""Spark operators for collateral, property-deal and vehicle data.

Layout
------
``functions``  Column expressions (no jobs, no Python per row)
``sources``    readers, writers and raw-text/HTML/JSON parsing
``operators``  DataFrame -> DataFrame operators
``plans``      whole flows and the registered queries on the shared tables
``streaming``  incremental forms of the batch operators
"""
