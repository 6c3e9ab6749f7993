"""streaming of specstrata."""
