"""tessera: cohort analytics and training-data preparation as plain Spark jobs."""
