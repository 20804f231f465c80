"""Stages: each takes and gives a DataFrame of items, and never collects."""
