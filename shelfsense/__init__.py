"""Customer and demand analytics as Spark jobs."""
