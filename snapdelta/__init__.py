"""Snapshot comparison as Spark DataFrame jobs."""
