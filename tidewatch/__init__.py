"""tidewatch: engagement-stream analytics on Spark (batch and Structured Streaming)."""
