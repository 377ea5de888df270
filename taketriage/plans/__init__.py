"""Plans: the bridge from the test tables and the query catalogue."""
