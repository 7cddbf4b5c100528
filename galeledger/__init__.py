"""Wind-energy economics on Spark: keyed DataFrame operators and batch jobs."""
