"""Readers, writers and incremental extraction."""
