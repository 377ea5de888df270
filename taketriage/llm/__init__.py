"""Operators for large training-data pipelines.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` are what the entry module registers.
"""
