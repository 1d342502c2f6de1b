"""Payment-pattern analytics as composable Spark DataFrame operators."""
