"""Operators of foliant."""
