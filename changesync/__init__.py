"""Two-way change-data synchronisation on Spark DataFrames and Structured Streaming."""
