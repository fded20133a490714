"""Resume and job-listing analytics as Spark DataFrame plans."""
