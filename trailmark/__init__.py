"""Session-log analytics as Spark DataFrame, SQL and Structured Streaming programs."""
