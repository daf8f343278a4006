"""Transaction analytics as Spark DataFrame operators."""
