"""Production-floor analytics as Spark DataFrame operators."""
