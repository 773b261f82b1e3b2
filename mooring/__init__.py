"""Workload-placement analytics as Spark DataFrame jobs."""
