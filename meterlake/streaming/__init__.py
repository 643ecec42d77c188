"""Continuous ingestion and versioned tables."""
