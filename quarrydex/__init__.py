"""A document index as Spark relations: dictionaries, postings, stored and column values, vectors, merges."""
