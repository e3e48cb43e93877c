"""All registered queries of the delayed-label engine and their SQL."""

from __future__ import annotations

from . import store_queries
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "fixed_wait_records"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "store_queries"]
