"""functions of specstrata."""
