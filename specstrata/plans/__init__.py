"""plans of specstrata."""
