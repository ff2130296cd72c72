"""Relational operators of the auditor: DataFrames in, DataFrames out."""
