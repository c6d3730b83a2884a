"""Lodestar: ranked retrieval and corpus analytics as Spark DataFrame programs."""
