"""Spark jobs for box, vector, score, federation and audit tables."""
