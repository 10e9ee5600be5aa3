"""The query catalogue: one entry per query over a folder of source tables."""

from __future__ import annotations

from pressline.plans import detail, events, ingest, layout, lists, mechanisms, messages, records, reviews, sites, sql_events, streams

MODULES = (events, messages, ingest, streams, layout, detail, sites, mechanisms, reviews, records, lists)
SQL = (sql_events, messages, ingest, streams, layout, detail, sites, mechanisms, reviews, records, lists)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in SQL for k, v in m.SQL.items()}
