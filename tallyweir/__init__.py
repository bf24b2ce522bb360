"""Field-survey and mark-recapture analytics as Spark DataFrame jobs."""
