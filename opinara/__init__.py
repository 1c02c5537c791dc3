"""Opinion analytics as Spark DataFrame operators."""
