"""A Spark-native engine for evolving knowledge records: bi-temporal facts, hybrid retrieval and consolidation."""
