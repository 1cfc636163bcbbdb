"""Operators of a training-data pipeline: one module per operator, one registry of queries."""
