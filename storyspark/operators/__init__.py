"""operators of storyspark."""
