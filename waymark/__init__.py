"""Coordinate mentions in large text collections, as Spark jobs."""
