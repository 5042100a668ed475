"""Versioned, deduplicated file-archive analytics and training-data operators on Spark."""
