"""Sources and sinks, and changes to stored tables."""
