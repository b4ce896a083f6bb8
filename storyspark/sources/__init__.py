"""sources of storyspark."""
