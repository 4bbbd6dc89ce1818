"""codeloom: repository analytics as composable Spark DataFrame operators."""
