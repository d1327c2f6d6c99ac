"""Structured Streaming entry points (the dashboard's click -> series loop)."""
