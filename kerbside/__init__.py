"""Road congestion analytics as Spark DataFrame jobs."""
