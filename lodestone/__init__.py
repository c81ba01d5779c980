"""Spark-first document evidence engine: parsing, passages, retrieval, incremental sync."""
