"""Whole plans: the item pipeline, jobs, the registry, and the query catalogue."""
