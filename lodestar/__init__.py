"""Lodestar: document analytics, retrieval and relationship graphs as Spark DataFrame plans."""
