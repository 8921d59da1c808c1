"""A Spark engine for single-cell spatial data."""
