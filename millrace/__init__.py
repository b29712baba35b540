"""millrace: a Spark-first engine for ingesting, cleaning, scoring and resolving records."""
