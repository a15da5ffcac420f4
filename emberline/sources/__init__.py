"""Readers, writers, the typed dimension load and the storage layout of the fact."""
