"""Code-and-knowledge analytics as Spark DataFrame programs."""
