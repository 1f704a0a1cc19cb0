"""Registered queries of the core and their SQL."""

from __future__ import annotations

from strandlake.plans import database, feeds, results, search_sql

QUERIES = {**feeds.QUERIES, **database.QUERIES, **results.QUERIES}
SQL = {**feeds.SQL, **database.SQL, **results.SQL, **search_sql.SQL}
FLAGSHIP = "search_fast"
