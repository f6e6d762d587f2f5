"""Training-data operators (large-corpus preparation) as Spark jobs."""
