"""Sensitive-data scanning, policy decisions, redaction and policy analytics as Spark jobs."""
