"""Lists of the administration and of tools: newest first, with fixed lengths, totals and
whether there is more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.operators import search
from pressline.operators.pages import API_LIMIT, TOOL_LIMIT, bounded

# The most rows that each list shows.
CAPS = {"reports": 90, "reviews": 100, "corrections": 200, "media": 200, "extractions": 200, "checkpoints": 500, "jobs": 500, "snapshots": 1000}


def newest(rows: DataFrame, kind: str, by: str, **equal) -> DataFrame:
    """The newest rows of a list, as many as its kind shows; ``equal`` restricts columns (null: not)."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.col(by).desc_nulls_first(), F.desc("id")).limit(CAPS[kind])


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose column is among the ids (first column of a frame, repeats do not
    matter): an IN list of any length as a semi-join."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def run_page(runs: DataFrame, source_id: int | None = None, status: str = "failed", descending: bool = True, limit: int = 25, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a page of connector runs, how many there are). ``runs``: id, source_id, status, started_us."""
    if status not in ("all", "completed", "failed"):
        raise ValueError(f"no such status: {status}")
    found = runs if source_id is None else runs.where(F.col("source_id") == source_id)
    found = found if status == "all" else found.where(F.col("status") == status)
    return search.page(found, ["started_us", "id"], descending, bounded(limit, API_LIMIT), offset), found.agg(F.count("*").alias("total"))


def report_summaries(reports: DataFrame, rows: DataFrame, visible: DataFrame) -> DataFrame:
    """The newest reports with their counts in all and by section. Of published reports
    only messages count that are still visible. ``reports``: id, report_date, status;
    ``rows``: report_date, section, id (of the message); ``visible``: id."""
    few = reports.orderBy(F.desc("report_date")).limit(CAPS["reports"])
    seen = rows.join(visible.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left")
    joined = few.join(seen.select("report_date", "section", "seen"), "report_date", "left")
    counts = F.col("section").isNotNull() & ((F.col("status") != "published") | F.coalesce("seen", F.lit(False)))
    per = joined.where(counts).groupBy("report_date", "section").agg(F.count("*").alias("n")).groupBy("report_date").agg(F.sum("n").alias("item_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("section_counts"))
    none = F.create_map().cast("map<string,bigint>")
    return few.join(per, "report_date", "left").select("id", "report_date", "status", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("section_counts", none).alias("section_counts"))


def withdrawn(reports: DataFrame, days: DataFrame, now_us: int) -> DataFrame:
    """``reports`` with those of the days (report_date) withdrawn that are not already."""
    hit = reports.join(days.select("report_date").distinct().withColumn("_hit", F.lit(True)), "report_date", "left")
    change = F.col("_hit").isNotNull() & (F.col("status") != "withdrawn")
    return hit.select(*(F.when(change, "withdrawn").otherwise(F.col(c)).alias(c) if c == "status" else F.when(change, F.lit(now_us)).otherwise(F.col(c)).alias(c) if c == "updated_us" else F.col(c) for c in reports.columns))


def evaluation_cases(reviews: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """Cases of the chosen reviews, to be labelled. ``reviews``: id, item_id, stage,
    proposal, feedback; ``items``: id, title, blocks (JSON)."""
    chosen = by_ids(reviews, ids)
    found = chosen.join(items.select(F.col("id").alias("item_id"), "title", "blocks"), "item_id", "left")
    return found.select(
        F.lit("admin-export-v1").alias("dataset_version"), F.concat(F.lit("review-"), F.col("id").cast("string")).alias("case_id"), F.col("stage").alias("task"), F.struct(F.col("item_id").alias("raw_item_id"), "title", "blocks").alias("input"),
        F.col("proposal").alias("model_output"), F.col("feedback").alias("correction"), F.col("id").alias("source_review_id"), F.lit("needs_admin_label").alias("label_status"),
    )


NEWS = ("id", "title", "summary", "products", "message_type", "topics", "importance_score", "source_name", "source_reliability_score", "author", "seen_us", "source_url")


def news_tool(items: DataFrame, links: DataFrame, sort_by: str = "time", sort: str = "desc", limit: int = 10, offset: int = 0, **filters) -> DataFrame:
    """A page of published messages in the narrow form of the tools: ``NEWS``, the ids of
    the events they belong to, total and has_more. ``links``: item_id, event_id. Events
    are looked up for the page alone."""
    page, total = search.search_published(items, sort_by, sort, bounded(limit, TOOL_LIMIT), offset, **filters)
    shown = page.select(*NEWS)
    related = by_ids(links.select("item_id", "event_id").distinct(), shown.select("id"), "item_id").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list("event_id")).alias("related_event_ids"))
    count = total.select("total").scalar()
    more = F.lit(offset + limit) < count
    return shown.join(related, "id", "left").select(*NEWS, F.coalesce("related_event_ids", F.array().cast("array<bigint>")).alias("related_event_ids"), count.alias("total"), more.alias("has_more"))
