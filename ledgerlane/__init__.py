"""Financial-statement analytics as Spark jobs."""
