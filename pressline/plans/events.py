"""Event queries over the news model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.lineage import materialised
from pressline.operators import events as E
from pressline.sources.adapter import known, view


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "mention")


def _snapshots(spark: SparkSession, d: str, mentions: DataFrame | None = None) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("confirmed", "resolved", "denied", None, "developing"))), (F.col("id") % 5 + 1).cast("int"))
    return (_mentions(spark, d) if mentions is None else mentions).select(F.col("id").alias("mention_id"), status.alias("lifecycle_status"))


def as_of(spark: SparkSession, d: str):
    """The reference time as a literal: the latest event."""
    return F.lit(known(spark, d).get("latest_us")).cast("long")


def heat_contributions(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("time_decay", "contribution")]
    return E.heat_contributions(_mentions(spark, d), as_of(spark, d)).select("event_id", "item_id", "base_weight", "source_repeat_factor", *rounded)


def refresh_all(spark, d):
    mentions = materialised(_mentions(spark, d))
    return E.refresh_event_metrics(mentions, as_of(spark, d), _snapshots(spark, d, mentions))


QUERIES = {
    "event_heat": lambda s, d: E.event_heat(_mentions(s, d), as_of(s, d)),
    "event_heat_contributions": heat_contributions,
    "event_credibility": lambda s, d: E.event_credibility(_mentions(s, d)),
    "event_importance": lambda s, d: E.event_importance(_mentions(s, d)),
    "event_importance_ignored": lambda s, d: E.importance_ignored(_mentions(s, d)),
    "event_times": lambda s, d: E.event_times(_mentions(s, d)),
    "event_references": lambda s, d: E.event_references(_mentions(s, d)),
    "event_lifecycle": lambda s, d: E.event_lifecycle(_mentions(s, d), _snapshots(s, d)),
    "event_refresh_all": refresh_all,
}
