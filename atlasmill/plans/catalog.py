"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from . import metric_queries, table_queries, text_queries  # noqa: F401
from .projection_queries import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
