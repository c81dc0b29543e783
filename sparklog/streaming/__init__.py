"""Growing logs."""
