"""Streaming queries, run over everything available; with the DuckDB SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.streaming import jobs


def stream_dedup(spark, d):
    """First event of each (user, type, payload)."""
    found = jobs.run_available(jobs.deduplicated(jobs.event_stream(spark, d), ["user_id", "event_type", "props"]))
    return found.select("user_id", "event_type", "props")


def stream_civil_day(spark, d):
    return jobs.run_available(jobs.civil_days(jobs.event_stream(spark, d)), "complete")


def stream_rolling_24h(spark, d):
    return jobs.run_available(jobs.rolling_day(jobs.event_stream(spark, d)), "complete")


def stream_ingest(spark, d):
    """Revisions of each user's state, taken in as a stream of events."""
    arrivals = jobs.event_stream(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), F.sha2("event_type", 256).alias("content_hash"))
    return jobs.run_available(jobs.ingested(arrivals)).select("key", "arrival", "revision")


QUERIES = {"stream_dedup": stream_dedup, "stream_civil_day": stream_civil_day, "stream_rolling_24h": stream_rolling_24h, "stream_ingest": stream_ingest}

_DAY, _H = 86_400_000_000, 3_600_000_000
SQL = {
    "stream_dedup": "select distinct user_id, event_type, props from events",
    "stream_civil_day": f"select ((epoch_us(ts) + 8 * {_H}) // {_DAY}) * {_DAY} - 8 * {_H} start_us, event_type, count(*) n, round(sum(value), 4) as value from events group by 1, 2",
    "stream_rolling_24h": f"with w as (select (epoch_us(ts) // {_H} - unnest(range(24))) * {_H} start_us, event_type from events) select start_us, event_type, count(*) n from w group by 1, 2",
    "stream_ingest": "with a as (select user_id as key, event_id arrival, event_type, lag(event_type) over (partition by user_id order by event_id) is distinct from event_type c from events) select key, arrival, row_number() over (partition by key order by arrival) revision from a where c",
}
