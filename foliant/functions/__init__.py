"""Functions of foliant."""
