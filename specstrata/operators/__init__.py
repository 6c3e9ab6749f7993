"""operators of specstrata."""
