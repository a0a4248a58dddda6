"""Movement-event analytics on Spark DataFrames."""
