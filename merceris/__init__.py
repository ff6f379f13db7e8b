"""Retail customer analytics and corpus preparation as Spark jobs."""
