"""Vehicle-telemetry analytics on Spark DataFrames."""
