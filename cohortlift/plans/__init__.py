"""Whole runs: which tables are built, reused and compared for a request."""
