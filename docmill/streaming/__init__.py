"""docmill.streaming."""
