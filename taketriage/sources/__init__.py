"""Sources, sinks and external connectors."""
