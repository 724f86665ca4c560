"""Customer-data analytics as PySpark DataFrame programs."""
