"""End-to-end mart compositions and the query catalogue."""
