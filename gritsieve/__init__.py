"""Data-quality profiling, cleaning and descriptive analytics as Spark DataFrame jobs."""
