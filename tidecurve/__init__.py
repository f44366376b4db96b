"""Glucose-response analytics and corpus preparation as Spark jobs."""
