"""Code-graph and project-memory analytics as lazy Spark DataFrames."""
