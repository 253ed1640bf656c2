"""Operators of a training-data pipeline: mixing, scoring, filtering, search and deduplication.

Nothing else in the library imports this subpackage.
"""
