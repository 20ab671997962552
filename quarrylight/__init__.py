"""Retrieval, session and corpus analytics as Spark DataFrame transformations."""
