"""sources of specstrata."""
