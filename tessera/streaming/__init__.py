"""Event-driven synchronisation on Structured Streaming."""
