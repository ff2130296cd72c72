"""loomaudit: site auditing as Spark DataFrames."""
