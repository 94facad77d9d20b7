"""Fleet telemetry analytics on Spark: DataFrame operators and streaming jobs."""
