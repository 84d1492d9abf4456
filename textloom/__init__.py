"""Text-corpus preparation as Spark DataFrame transformations."""
