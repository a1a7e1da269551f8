"""Readers and writers of alignment files, and reads made from other tables."""
