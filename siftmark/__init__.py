"""Scanner scoring and ground-truth building as Spark jobs."""
