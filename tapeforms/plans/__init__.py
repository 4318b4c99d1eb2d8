"""Settings and the catalog of queries."""
