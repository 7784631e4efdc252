"""Batch and streaming jobs that keep document collections searchable and check answers drawn from them."""
