"""extract of specstrata."""
