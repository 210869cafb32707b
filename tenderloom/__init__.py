"""Procurement notice analytics on Spark: map, ingest, audit and score public notices."""
