"""Continuous ingest into epoch tables."""
