"""Candidate events for a message's membership decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import text as T
from pressline.functions import vocab as V
from pressline.operators.messages import event_families

DAY = 86_400_000_000
WINDOW_DAYS, SCANNED, KEPT, TEXT = 60, 500, 12, 4000
#: Stands for the products of an event that has several.
MIXED = "*"


def recall_candidates(items: DataFrame, events: DataFrame, limit: int = KEPT) -> DataFrame:
    """item_id, event_id, score, reasons, position. ``items``: id, products, topics,
    title, summary, content, seen_us, anchors; ``events``: id, products, event_family,
    title, summary, last_seen_us, created_us, anchors.

    A message with known products meets events of one of them alone; one without meets
    events of any products. An event of one known product must be of a family that the
    product has. Only the newest ``SCANNED`` events (an unknown time counts as newest)
    can be candidates of any message, because the look-back only cuts the older end.
    That bound makes them small enough to send to every task, so messages are not
    shuffled for the join; the ranking groups by message."""
    newest = events.orderBy(F.col("last_seen_us").desc_nulls_first(), F.col("id").desc()).limit(SCANNED)
    single = F.when(F.size("products") == 1, F.get("products", F.lit(0))).otherwise(MIXED)
    e = newest.select(
        F.col("id").alias("event_id"), F.col("products").alias("event_products"), single.alias("event_product"), "event_family", F.col("last_seen_us").alias("event_seen"),
        F.coalesce("last_seen_us", "created_us").alias("event_us"), F.col("anchors").alias("event_anchors"), T.word_set(F.concat_ws(" ", "title", "summary")).alias("event_words"),
    )
    supports = F.create_map(*(x for p, fs in V.PRODUCT_EVENT_FAMILIES.items() for x in (F.lit(p), F.array(*map(F.lit, fs)))))
    e = e.where(F.col("event_product").isin("unknown", MIXED) | F.array_contains(supports[F.col("event_product")], F.col("event_family")))
    concrete = F.filter("products", lambda p: p != "unknown")
    every = F.array(*(F.lit(p) for p in (*V.PRODUCT_EVENT_FAMILIES, "unknown", MIXED)))
    text = F.concat_ws(" ", *(F.when(F.length(c) > 0, F.col(c)) for c in ("title", "summary")), F.substring("content", 1, TEXT))
    # words and families of a message are worked out before it is dealt over products and families
    said = items.select(
        F.col("id").alias("item_id"), "products", "seen_us", "anchors", T.word_set(text).alias("words"),
        F.when(F.size(concrete) > 0, concrete).otherwise(every).alias("of"), event_families(F.col("products"), F.col("topics")).alias("families"),
    )
    own = ["item_id", "products", "seen_us", "anchors", "words"]
    i = said.select(*own, "families", F.explode("of").alias("event_product")).select(*own, "event_product", F.explode("families").alias("event_family"))
    joined = i.join(F.broadcast(e), ["event_product", "event_family"]).where(F.col("event_seen").isNull() | (F.col("event_seen") >= F.col("seen_us") - WINDOW_DAYS * DAY))
    # each part of the score once; a candidate pair is scored before it is ranked
    same, overlap, alike = F.arrays_overlap("products", "event_products"), F.size(F.array_intersect("anchors", "event_anchors")), T.jaccard(F.col("words"), F.col("event_words"))
    parts = joined.select("item_id", "event_id", "seen_us", "event_us", same.alias("same"), overlap.alias("overlap"), alike.alias("alike"))
    age = F.abs(F.col("seen_us") - F.col("event_us")) / F.lit(float(DAY))
    score = F.lit(30.0) + F.when(F.col("same"), 20.0).otherwise(0.0) + F.least(F.lit(30), 10 * F.col("overlap")) + 30 * F.col("alike") + F.greatest(F.lit(0.0), 20 * (1 - age / WINDOW_DAYS))
    why = F.concat_ws(",", F.lit("family_hint"), F.when(F.col("same"), "product_overlap"), F.when(F.col("overlap") > 0, "entity_overlap"), F.when(F.col("alike") > 0, "text_overlap"), F.lit("recent_activity"))
    ranked = parts.withColumn("raw", score).withColumn("reasons", why)
    ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("raw").desc(), F.col("event_id").desc())))
    return ranked.where(F.col("position") <= limit).select("item_id", "event_id", F.round("raw", 4).alias("score"), "reasons", "position")
