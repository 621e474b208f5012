"""Security-event analytics expressed as Spark DataFrame, SQL and Structured Streaming operators."""
