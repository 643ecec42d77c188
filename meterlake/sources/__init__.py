"""Readers of logs, reports and manifests, and the table facade."""
