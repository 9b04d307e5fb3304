"""Plans of foliant."""
