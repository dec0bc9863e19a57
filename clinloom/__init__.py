"""Clinical analytics on Spark: cohorts, joins, cleaning, profiling and statistics on DataFrames."""
