"""Construction quantity and cost analytics on Spark tables."""
