"""Spark jobs for news and evidence intelligence over tables and streams."""
