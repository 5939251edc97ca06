"""Raw exports in, cleaned tables and report artifacts out."""
