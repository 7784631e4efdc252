"""Readers, loaders and stored tables."""
