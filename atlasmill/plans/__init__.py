"""Runnable queries and end-to-end jobs."""
