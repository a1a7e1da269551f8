"""Whole runs: files in, marked and sorted files out."""
