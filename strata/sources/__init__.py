"""Table scans, derived inputs, log and activity sources."""
