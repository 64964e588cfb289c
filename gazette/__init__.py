"""Spark jobs for a keyword-matched weekly digest: entries, issues, subscribers, deliveries."""
