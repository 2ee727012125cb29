"""Per-row stages on Structured Streaming."""
