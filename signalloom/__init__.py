"""A PySpark engine for finding recurring, evidence-backed problem reports in public posts, comments and reviews."""
