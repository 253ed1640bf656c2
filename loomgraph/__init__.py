"""Property-graph queries, graph algorithms and analytics on Spark DataFrames."""
