"""Readers, writers and the views that shape input tables."""
