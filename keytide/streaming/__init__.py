"""Continuous ingestion and continuously maintained views."""
