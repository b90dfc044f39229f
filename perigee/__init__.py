"""Near-Earth-object analytics as Spark DataFrame pipelines."""
