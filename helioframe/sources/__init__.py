"""Readers and writers: raw feeds, the dataset store, file integrity, run results."""
