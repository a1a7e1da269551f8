"""Marking of records as they arrive."""
