"""Layer builds, experiments and the query catalogue."""
