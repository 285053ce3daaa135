"""Market-research documents and the predictions drawn from them, as Spark DataFrame jobs."""
