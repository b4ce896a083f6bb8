"""streaming of storyspark."""
