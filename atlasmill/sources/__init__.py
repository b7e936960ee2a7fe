"""Readers and writers; every reader returns a DataFrame."""
