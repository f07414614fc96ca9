"""Change-data workloads and incremental lake tables on Spark DataFrames."""
