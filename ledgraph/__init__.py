"""Property graphs whose source of truth is an append-only log of operations, on Spark DataFrames."""
