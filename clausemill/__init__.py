"""Contract-text analytics as Spark DataFrame jobs."""
