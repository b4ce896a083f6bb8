"""functions of storyspark."""
