"""plans of storyspark."""
