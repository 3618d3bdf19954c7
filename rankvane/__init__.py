"""Match-history features, ratings and evaluation as Spark DataFrame jobs."""
