"""Sources, sinks and table schemas."""
