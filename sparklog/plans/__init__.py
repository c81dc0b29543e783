"""What is decided before anything runs: templates, patterns, timestamp layouts, filters."""
