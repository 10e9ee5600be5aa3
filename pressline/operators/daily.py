"""The ranked daily report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import vocab as V
from pressline.functions.lineage import materialised
from pressline.operators.messages import report_section
from pressline.operators.search import civil_date

REPORT_FROM = 0.60


def eligible(items: DataFrame) -> DataFrame:
    """Published originals of enough importance, with their Shanghai day; a message
    without its own publication time has no day."""
    kept = items.where((F.col("status") == "published") & (F.col("content_form") == "original") & (F.col("importance_score") >= REPORT_FROM) & F.col("published_us").isNotNull())
    return kept.withColumn("report_date", civil_date(F.col("published_us")))


def eligible_days(items: DataFrame) -> DataFrame:
    return eligible(items).groupBy("report_date").agg(F.count("*").alias("n"))


def greedy_disjoint(rows: DataFrame, links: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of a greedy choice within each key: by falling ``order`` (unique in a key) a
    row is taken unless it shares a link with one taken before. ``rows``: key, id, order;
    ``links``: key, id, order and link.

    Works in rounds: a row that comes first in all its links is taken, whatever shares one of
    them leaves, and what is left goes on. Rows without a link that another one has are
    taken at once. So a key is never walked by one task; a round costs windows by
    link and by row, over the rows that are still open alone."""
    by_link, by_row = Window.partitionBy(*key, "link"), Window.partitionBy(*key, "id")
    shared = links.withColumn("n", F.count("*").over(by_link)).withColumn("most", F.max("n").over(by_row))
    open_ = materialised(shared.where("most > 1").select(*key, "id", order, "link"))
    lost = None
    while not open_.isEmpty():
        first = open_.withColumn("first", F.col(order) == F.max(order).over(by_link)).withColumn("taken", F.min("first").over(by_row))
        met = first.withColumn("closed", F.max("taken").over(by_link)).withColumn("leaves", F.max("closed").over(by_row))
        judged = materialised(met.select(*key, "id", order, "link", "taken", "leaves"))
        gone = judged.where("leaves and not taken").select(*key, "id").distinct()
        lost = gone if lost is None else lost.unionByName(gone)
        open_ = judged.where("not leaves").select(*key, "id", order, "link")
    return rows if lost is None else rows.join(lost, [*key, "id"], "left_anti")


def daily_report(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """report_date, section, position, id. Within a day, messages in falling (score,
    time, id) are taken unless one of their events was taken before; a message that is
    left out blocks nothing. Ranks then cut the sections."""
    able = eligible(items).select("report_date", "id", F.struct(F.col("importance_score").alias("score"), "published_us", "id").alias("rank"), report_section(F.col("products")).alias("section"))
    able = materialised(able)
    links = mentions.select(F.col("item_id").alias("id"), F.col("event_id").alias("link")).distinct().join(able.select("report_date", "id", "rank"), "id")
    kept = greedy_disjoint(able, links, ["report_date"], "rank")
    ranked = kept.withColumn("position", F.row_number().over(Window.partitionBy("report_date", "section").orderBy(F.desc("rank"))))
    limit = F.create_map(*(F.lit(x) for kv in V.REPORT_SECTIONS.items() for x in kv))[F.col("section")]
    return ranked.where(F.col("position") <= limit).select("report_date", "section", "position", "id")


def report_counts(report: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("section") == s).alias(s)
    return report.groupBy("report_date").agg(*(one(s) for s in V.REPORT_SECTIONS))


def scheduled_instant(report_date: Column, zone: str = "Asia/Shanghai") -> Column:
    """When a day's report is due, in microseconds: as the next day begins in the zone."""
    return F.unix_micros(F.to_utc_timestamp(F.date_add(F.to_date(report_date), 1).cast("timestamp"), zone))


def due_report_date(now_us: Column, zone: str = "Asia/Shanghai") -> Column:
    """The day whose report is due at a time: the last one that is over in the zone."""
    return F.date_sub(civil_date(now_us, zone), 1)


def needs_regeneration(reports: DataFrame, updates: DataFrame, grace_us: int) -> DataFrame:
    """Days whose report is to be written again: last written before its schedule, or
    an eligible row changed later and within the grace after it; never withdrawn ones.
    ``reports``: report_date, scheduled_us, written_us, withdrawn; ``updates``: report_date, updated_us."""
    late = updates.groupBy("report_date").agg(F.max("updated_us").alias("updated_us"))
    joined = reports.where("not withdrawn").join(late, "report_date", "left")
    early = F.col("written_us") < F.col("scheduled_us")
    changed = F.coalesce((F.col("updated_us") > F.col("written_us")) & (F.col("updated_us") <= F.col("scheduled_us") + grace_us), F.lit(False))
    return joined.where(early | changed).select("report_date")
