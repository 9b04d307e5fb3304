"""Sources of foliant."""
