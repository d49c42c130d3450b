"""Batch document retrieval, grounded answering and corpus preparation on Spark."""
