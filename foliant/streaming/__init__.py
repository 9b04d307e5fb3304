"""Streaming of foliant."""
