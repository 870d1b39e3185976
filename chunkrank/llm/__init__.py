"""Operators of a training-data pipeline: tokenising, extraction, deduplication, filtering, packing.

Nothing else in the library imports this subpackage.
"""
