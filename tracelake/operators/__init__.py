"""Operators on trace tables: DataFrames in, DataFrames out."""
