"""Feed analytics expressed as Spark DataFrame and SQL programs."""
