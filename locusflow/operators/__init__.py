"""Operators on DataFrames of alignment records."""
