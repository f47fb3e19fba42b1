"""Table readers, stream readers, sinks and input validation."""
