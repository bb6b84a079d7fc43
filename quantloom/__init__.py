"""Market analytics as Spark DataFrame transformations."""
