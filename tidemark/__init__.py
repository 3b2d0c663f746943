"""Temporal-shift analytics for event data, written as Spark DataFrame jobs."""
