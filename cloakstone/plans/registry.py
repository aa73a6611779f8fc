"""The registered queries and their SQL."""

from __future__ import annotations

from . import detect_queries, policy_queries

QUERIES = {**policy_queries.QUERIES, **detect_queries.QUERIES}
ORACLE_SQL = {**policy_queries.SQL, **detect_queries.SQL}
