"""Operators of a training-data pipeline: one module for each, digest queries in ``queries.py``."""
