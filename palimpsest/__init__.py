"""Text anonymisation and span analytics over Spark DataFrames."""
