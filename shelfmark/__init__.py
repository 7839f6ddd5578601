"""A Spark-first engine for product catalogues."""
