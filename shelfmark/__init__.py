"""shelfmark: preparing, indexing and searching document collections with Spark."""
