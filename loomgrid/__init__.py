"""Document-grid analytics as composable Spark DataFrame transformations."""
