"""storyspark: narrative-text and ordered-beat analytics as Spark DataFrame operators."""
