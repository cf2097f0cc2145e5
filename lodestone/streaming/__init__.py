"""Change streams, windows and ordered folds."""
