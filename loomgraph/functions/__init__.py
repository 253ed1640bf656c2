"""Scalar and aggregate functions of the query language."""
