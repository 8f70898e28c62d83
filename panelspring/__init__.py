"""Market panels and the news around them, as Spark DataFrame operations."""
