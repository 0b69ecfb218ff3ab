"""Spark-native analytics over code changes: hunks, symbols, edges, orderings and reports as DataFrames."""
