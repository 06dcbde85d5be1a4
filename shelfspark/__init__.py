"""Building and searching indexes of technical documentation with Spark."""
