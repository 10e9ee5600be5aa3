"""Search, paging, histograms and status pages. Parameters become one filter, so that
it reaches the scan; a page is a top-N; totals are a separate aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import vocab as V
from pressline.operators.events import level
from pressline.operators.messages import event_category

FEATURED_FROM = 0.75
#: Columns that a text query looks at, those of the message, its author and its source.
SEARCHED = ("title", "translated_title", "summary", "content", "translated_text", "author", "source_name")


def civil_date(us: Column, zone: str = "Asia/Shanghai") -> Column:
    """Local date of an instant in microseconds (session zone UTC)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(us).cast("timestamp_ntz")))


def published_filter(
    product: str | None = None, message_type: str | None = None, topic: str | None = None, min_importance: float | None = None, featured: bool = False,
    query: str | None = None, since_us: int | None = None, until_us: int | None = None, day: str | None = None, zone: str = "Asia/Shanghai", text_columns: tuple[str, ...] = SEARCHED,
) -> Column:
    """The conjunction of the given predicates over published messages."""
    c = F.col("status") == "published"
    if message_type:
        c &= F.col("message_type") == message_type
    if product:
        c &= F.array_contains("products", product)
    if topic:
        c &= F.array_contains("topics", topic)
    if min_importance is not None:
        c &= F.col("importance_score") >= min_importance
    elif featured:
        c &= F.col("importance_score") >= FEATURED_FROM
    if featured:
        c &= F.col("content_form") != "repost"
    q = (query or "").strip()
    if q.isdigit():
        c &= F.col("id") == int(q)
    elif q:  # per cent and underscore in the query stay wildcards
        hit = F.lit(False)
        for name in text_columns:
            hit = hit | F.coalesce(F.col(name).ilike(f"%{q}%"), F.lit(False))
        c &= hit
    if since_us is not None:
        c &= F.col("seen_us") >= since_us
    if until_us is not None:
        c &= F.col("seen_us") < until_us
    if day is not None:
        c &= civil_date(F.col("seen_us"), zone) == F.lit(day).cast("date")
    return c


def _order(columns: list[str], descending: bool) -> list[Column]:
    # nulls are largest, as in the store that the pages come from
    return [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c in columns]


def page(df: DataFrame, by: list[str], descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return df.orderBy(*_order(by, descending)).offset(offset).limit(limit)


def _searched(items: DataFrame, filters: dict) -> dict:
    """The filters, with the text columns that the messages have."""
    return {"text_columns": tuple(c for c in SEARCHED if c in items.columns), **filters}


PUBLISHED_SORTS = {"time": "seen_us", "importance": "importance_score", "priority": "priority_score", "intrinsic": "importance_score"}


def search_published(items: DataFrame, sort_by: str = "time", sort: str = "desc", limit: int = 25, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the published messages that match."""
    if sort_by not in PUBLISHED_SORTS:
        raise ValueError("unsupported sort")
    found = items.where(published_filter(**_searched(items, filters)))
    return page(found, [PUBLISHED_SORTS[sort_by], "id"], sort != "asc", limit, offset), found.agg(F.count("*").alias("total"))


def published_days(items: DataFrame, limit: int = 30, zone: str = "Asia/Shanghai", **filters) -> DataFrame:
    """Newest civil days with messages: day, count, latest. Aggregates before it cuts."""
    days = items.where(published_filter(zone=zone, **_searched(items, filters))).groupBy(civil_date(F.col("seen_us"), zone).alias("day"))
    return days.agg(F.count("*").alias("n"), F.max("seen_us").alias("latest_us")).orderBy(F.col("day").desc()).limit(limit)


def event_view(stories: DataFrame) -> DataFrame:
    """Stories with products, category, levels and the time that lists sort by."""
    return stories.withColumns({
        "products": F.array("product"), "category": event_category(F.col("event_family"), F.array("product")),
        "importance_level": level(F.col("importance_score"), V.IMPORTANCE_LEVELS), "heat_level": level(F.col("heat_score"), V.HEAT_LEVELS),
        "time_us": F.coalesce("last_material_us", "last_seen_us", "created_us"),
    })


EVENT_SORTS = {"time": "time_us", "latest": "time_us", "importance": "importance_score", "heat": "heat_score"}


def search_events(
    stories: DataFrame, mentions: DataFrame, query: str | None = None, product: str | None = None, since_us: int | None = None, until_us: int | None = None,
    sort_by: str = "time", sort: str = "desc", limit: int = 25, offset: int = 0, **equal: str | None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total) of events with a current mention; ``equal`` may hold category,
    event_family, lifecycle, credibility_level, importance_level and heat_level."""
    if sort_by not in EVENT_SORTS:
        raise ValueError("unsupported sort")
    c = F.lit(True)
    for name, value in equal.items():
        if value:
            c &= F.col(name) == value
    if product:
        c &= F.array_contains("products", product)
    q = (query or "").strip().lower()
    if q:
        c &= F.col("title").ilike(f"%{q}%") | F.col("summary").ilike(f"%{q}%")
    if since_us is not None:
        c &= F.col("time_us") >= since_us
    if until_us is not None:
        c &= F.col("time_us") < until_us
    live = mentions.select(F.col("event_id").alias("id")).distinct()
    found = event_view(stories).where(c).join(live, "id", "left_semi")
    return page(found, [EVENT_SORTS[sort_by], "time_us", "id"], sort != "asc", limit, offset), found.agg(F.count("*").alias("total"))


def event_message_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("event_id").agg(F.countDistinct("item_id").alias("messages"), F.countDistinct("source_id").alias("sources"))


def event_associations(mentions: DataFrame, stories: DataFrame) -> DataFrame:
    """Distinct (message, event) pairs with the event's labels."""
    pairs = mentions.select("item_id", "event_id").distinct()
    s = event_view(stories).select(F.col("id").alias("event_id"), "title", "event_family", "lifecycle", "credibility_level", "heat_level")
    return pairs.join(s, "event_id")


def event_timeline(mentions: DataFrame) -> DataFrame:
    """Mentions of each event in time order, numbered."""
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("time_us", "id"))
    return mentions.select("event_id", n.alias("position"), "item_id", "relation", "materiality", "time_us")


# ---- raw items and their processing ------------------------------------------------


def latest_raw(raws: DataFrame) -> DataFrame:
    """Raw items that no later revision supersedes."""
    newer = raws.where("supersedes is not null").select(F.col("supersedes").alias("id"))
    return raws.join(newer, "id", "left_anti")


def pending_raw(raws: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest raw items with neither a normalized row nor a run."""
    done = items.select(F.col("raw_item_id").alias("id")).union(runs.select(F.col("raw_item_id").alias("id"))).distinct()
    return latest_raw(raws).join(done, "id", "left_anti")


def latest_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The columns of the row with the highest id of each key; one aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), "id").alias("_l")).select(key, *(F.col(f"_l.{c}").alias(c) for c in columns))


def admin_status(raws: DataFrame, items: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """id, process_status of the latest raw items: failed, processing, completed or pending."""
    j = latest_by(jobs, "raw_item_id", "status", "attempts").select(F.col("raw_item_id").alias("id"), F.col("status").alias("job"), (F.col("attempts") < 3).alias("retry"))
    r = latest_by(runs, "raw_item_id", "status").select(F.col("raw_item_id").alias("id"), F.col("status").alias("run"))
    i = items.select("id", F.col("status").alias("published"), "message_type")
    rows = latest_raw(raws).join(i, "id", "left").join(j, "id", "left").join(r, "id", "left")
    no = F.lit(False)
    active = F.coalesce(F.col("job").isin("queued", "running") | ((F.col("job") == "failed") & F.col("retry")), no)
    failed = F.coalesce((F.col("job") == "failed") & ~F.col("retry"), no) | (~active & F.coalesce(F.col("run") == "failed", no))
    processing = active | F.coalesce(F.col("run").isin("running", "awaiting_review"), no)
    completed = F.coalesce(F.col("published") == "published", no) | F.coalesce(F.col("job") == "completed", no) | F.coalesce(F.col("run") == "completed", no)
    return rows.withColumn("process_status", F.when(failed, "failed").when(processing, "processing").when(completed, "completed").otherwise("pending"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """All statuses in one pass."""
    one = lambda s: F.count_if(F.col("process_status") == s).alias(s)
    return statuses.agg(F.count("*").alias("all"), one("failed"), one("processing"), one("completed"), one("pending"))


def raw_status(raws: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """id, status of every raw item: that of its latest run while it is open or failed,
    else analyzed if a message of it is published, else pending."""
    r = latest_by(runs, "raw_item_id", "status").select(F.col("raw_item_id").alias("id"), F.col("status").alias("run"))
    live = items.where("status = 'published'").select("id", F.lit(True).alias("live"))
    rows = raws.select("id").join(r, "id", "left").join(live, "id", "left")
    status = F.when(F.col("run").isin("running", "awaiting_review", "failed"), F.col("run")).when(F.col("live"), "analyzed").otherwise("pending")
    return rows.select("id", status.alias("status"))
