"""Corpus curation and analytics as lazy Spark DataFrame transformations."""
