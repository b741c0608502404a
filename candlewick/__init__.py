"""candlewick: technical-analysis and time-series operators on Spark DataFrames."""
