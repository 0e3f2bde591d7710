"""A document-retrieval engine whose operators are Spark DataFrame plans."""
