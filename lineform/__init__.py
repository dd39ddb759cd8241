"""Contract-typed, line-oriented record documents as Spark DataFrames."""
