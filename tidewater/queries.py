"""All registered queries of the analytics operators and their oracle SQL."""

from __future__ import annotations

from tidewater.plans import cleaning_queries, period_queries, price_queries, record_queries, signal_queries, text_queries, trade_queries, venue_queries

_PARTS = (trade_queries, price_queries, period_queries, signal_queries, cleaning_queries, text_queries, record_queries, venue_queries)

#: Queries over whole tables are written as ``<name>_all`` in their modules, beside restricted forms that are gone, and registered once, under the plain name.
QUERIES = {name.removesuffix("_all"): query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name.removesuffix("_all"): sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
