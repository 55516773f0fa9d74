"""Timeline and interval analytics on Spark."""
