"""Relational and numeric operators; each takes and returns DataFrames."""
