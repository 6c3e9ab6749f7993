"""specstrata: PySpark-native mining of specification corpora and their crawl data."""

__version__ = "0.1.0"
