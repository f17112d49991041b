"""Operators of a training-data pipeline: deduplication, scoring, privacy, packing, search.

Nothing else in the library imports this package.
"""
