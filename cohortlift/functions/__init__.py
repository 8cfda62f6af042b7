"""Column expressions: codes, paths and scores."""
