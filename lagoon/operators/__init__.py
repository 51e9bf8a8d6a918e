"""Operators: DataFrames and column names in, DataFrames out; no operator runs an action."""
