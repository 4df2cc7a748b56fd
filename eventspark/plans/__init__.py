"""Pipelines of operators, given as data."""
