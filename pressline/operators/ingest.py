"""Revisions, supersession, cursors, memberships and outbox: the incremental side as
transformations of whole histories. The streaming twins are in ``pressline.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions(arrivals: DataFrame) -> DataFrame:
    """key, arrival, content_hash -> action, revision, supersedes. A row makes a
    revision if its content differs from the latest one, not from any earlier one:
    A, B, A are three revisions."""
    w = Window.partitionBy("key").orderBy("arrival")
    changed = F.coalesce(F.lag("content_hash").over(w) != F.col("content_hash"), F.lit(True))
    rows = arrivals.withColumn("_c", changed).withColumn("revision", F.sum(F.col("_c").cast("int")).over(w))
    earlier = F.last(F.when(F.col("_c"), F.col("arrival")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    action = F.when(~F.col("_c"), "skip").when(F.col("revision") == 1, "create").otherwise("revise")
    return rows.withColumn("supersedes", F.when(F.col("_c"), earlier)).withColumn("action", action).drop("_c")


def supersede_cascade(raws: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a new revision does to its predecessor: id, item status, jobs to cancel."""
    old = raws.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    active = jobs.where(F.col("status").isin("queued", "running")).groupBy(F.col("raw_item_id").alias("id")).agg(F.count("*").alias("cancelled_jobs"))
    i = items.select("id", F.when(F.col("status") == "withdrawn", "withdrawn").otherwise("superseded").alias("item_status"))
    return old.join(i, "id", "left").join(active, "id", "left").select("id", "item_status", F.coalesce("cancelled_jobs", F.lit(0)).alias("cancelled_jobs"))


def memberships(decisions: DataFrame) -> DataFrame:
    """Valid membership rows of decisions: the event is the given one, or for a creation
    derived from the mention's key; repeated decisions on a key are one row; keys with
    contradicting targets are left out (``membership_conflicts`` lists them)."""
    key = ["item_id", "item_revision", "mention_index", "policy"]
    target = F.when(F.col("action") == "attach", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).when(F.col("action") == "create", F.concat_ws(":", F.lit("new"), *key))
    rows = decisions.where(F.col("action").isin("attach", "create")).select(*key, target.alias("event_key"), "relation").where("event_key is not null")
    grouped = rows.groupBy(*key).agg(F.countDistinct("event_key").alias("n"), F.min("event_key").alias("event_key"), F.min("relation").alias("relation"))
    return grouped.where("n = 1").drop("n")


def membership_conflicts(decisions: DataFrame) -> DataFrame:
    key = ["item_id", "item_revision", "mention_index", "policy"]
    chosen = decisions.where(F.col("action").isin("attach", "create"))
    return chosen.groupBy(*key).agg(F.countDistinct("action", F.coalesce("event_id", F.lit(-1))).alias("targets")).where("targets > 1")


def decision_error(action: Column, event_id: Column, candidates: Column, product: Column, products: Column, family: Column, families: Column, is_repost: Column) -> Column:
    """First violated rule of a membership decision, or null."""
    return (
        F.when(~action.isin("attach", "create", "ignore"), "unsupported action")
        .when((action == "attach") & event_id.isNull(), "attach needs an event")
        .when((action != "attach") & event_id.isNotNull(), "only attach names an event")
        .when((action == "attach") & ~F.coalesce(F.array_contains(candidates, event_id), F.lit(False)), "event is no candidate")
        .when((action != "ignore") & ~F.coalesce(F.array_contains(products, product), F.lit(False)), "product is not the message's")
        .when((action != "ignore") & ~F.coalesce(F.array_contains(families, family), F.lit(False)), "family is outside the space")
        .when((action == "create") & is_repost, "a repost creates no event")
    )


def first_in_bucket(alerts: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """One alert per key and cool-down bucket: the earliest, then the lowest id."""
    bucket = F.floor(F.col("us") / F.lit(1_000_000 * seconds)).cast("long")
    return alerts.groupBy(*key, bucket.alias("bucket")).agg(F.min_by(F.struct("id", "us"), F.struct("us", "id")).alias("f"), F.count("*").alias("n")).select(*key, "bucket", "f.id", "f.us", "n")


def insert_new(existing: DataFrame, rows: DataFrame, key: str = "dedupe_key", order: str = "id") -> DataFrame:
    """The rows that an insert-or-ignore would add: first of each key that is not there yet."""
    first = rows.groupBy(key).agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("r")).select(key, "r.*")
    return first.join(existing.select(key), key, "left_anti").select(*rows.columns)


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key; the rest stays."""
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_keys(table: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(what remains, count of what a delete of the keys removes)."""
    k = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return table.join(k, column, "left_anti"), table.join(k, column, "left_semi").agg(F.count("*").alias("n"))


def advance_cursor(batches: DataFrame) -> DataFrame:
    """The cursor of each source after all its batches, in batch order. A truncated
    batch keeps the watermark and gathers pending ids and their highest time; the next
    complete one promotes the highest time seen and forgets them. ``batches``: source,
    batch, truncated, ids (array), high_us (highest time of the batch, may be null), and if
    there is one, skipped (ids that were looked at and are not to be fetched again).

    The last complete batch tells all: times up to it make the watermark, what comes
    behind it is pending. So batches are aggregated and never walked one after another."""
    ids = F.concat("ids", F.coalesce("skipped", F.array().cast("array<string>"))) if "skipped" in batches.columns else F.col("ids")
    last = batches.where(~F.col("truncated")).groupBy("source").agg(F.max("batch").alias("_last"))
    rows = batches.select("source", "batch", "high_us", ids.alias("ids")).join(last, "source", "left")
    done = F.coalesce(F.col("batch") <= F.col("_last"), F.lit(False))
    sums = rows.groupBy("source").agg(F.max(F.when(done, F.col("high_us"))).alias("watermark_us"), F.max(F.when(~done, F.col("high_us"))).alias("pending_high_us"))
    pending = rows.where(~done).select("source", F.explode("ids").alias("id")).distinct().groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("pending_ids"))
    return sums.join(pending, "source", "left").select("source", "watermark_us", "pending_high_us", F.coalesce("pending_ids", F.lit("")).alias("pending_ids"))
