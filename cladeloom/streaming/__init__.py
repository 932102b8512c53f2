"""Continuous ingestion of gene trees."""
