"""groundspark: verifiable retrieval and corpus preparation as Spark DataFrame jobs."""
