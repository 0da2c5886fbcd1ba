"""Relational, scoring and governance operators: pure functions from DataFrames to DataFrames."""
