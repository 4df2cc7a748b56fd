"""Sources of events."""
