"""Sources, sinks and reports."""
