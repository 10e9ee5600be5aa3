"""Scores and projections of events from their mentions.

Every function takes a DataFrame of mentions (one row per event and message mention)
and returns one row per event. Times are epoch microseconds. A mention needs, as far
as a function uses them: event_id, id, item_id, item_revision, mention_index,
source_id, content_form, materiality, fingerprint, relation, source_role,
independence_group, reliability, importance_profile, importance_score, seen_us (the
message's own time), time_us (the mention's time) and has_media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import vocab as V

HOUR = 3_600_000_000
DAY = 24 * HOUR


def level(score: Column, steps) -> Column:
    """Name of the first step whose upper end lies above the score."""
    out = F.lit(steps[-1][1])
    for end, name in reversed(steps[:-1]):
        out = F.when(score < end, name).otherwise(out)
    return out


def role_rank(role: Column) -> Column:
    out = F.lit(0)
    for name, (rank, _, _) in V.SOURCE_ROLES.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


# ---- heat -----------------------------------------------------------------------


def _marked(mentions: DataFrame) -> DataFrame:
    """Adds ``_kept``: the newest mention of each (source, fingerprint), all without a
    fingerprint, and of those one per message: one without a fingerprint if there is
    one, then the latest id. Rows are marked, not dropped, so that one grouping can
    count both sides."""
    has = F.coalesce(F.length("fingerprint") > 0, F.lit(False))
    newest = F.row_number().over(Window.partitionBy("event_id", "source_id", "fingerprint").orderBy(F.col("seen_us").desc(), "id"))
    first = mentions.withColumn("_fp", has).withColumn("_first", ~F.col("_fp") | (newest == 1))
    last = F.row_number().over(Window.partitionBy("event_id", "item_id", "_first").orderBy("_fp", F.col("id").desc()))
    return first.withColumn("_kept", F.col("_first") & (last == 1)).drop("_fp", "_first")


def base_weight() -> Column:
    return (
        F.when(F.col("content_form") == "repost", 0.25)
        .when(F.col("materiality") == "duplicate", 0.0)
        .when(F.col("content_form") == "quote", F.when(F.col("materiality") == "material_update", 0.7).otherwise(0.4))
        .otherwise(1.0)
    )


def _with_contribution(marked: DataFrame, ref: Column) -> DataFrame:
    """Weight, decay (half-life 12 hours) and repeat factor of each row; rows that are not
    kept or older than seven days are marked and neither count nor repeat."""
    seen = F.col("seen_us")
    rows = marked.withColumn("_eligible", F.col("_kept") & (seen >= ref - 7 * DAY))
    by_time = Window.partitionBy("event_id", "source_id", "_eligible").orderBy("seen_us")
    peers = Window.partitionBy("event_id", "source_id", "_eligible", "seen_us")
    earlier = F.count("*").over(by_time.rangeBetween(-6 * HOUR, 0)) - F.count("*").over(peers) + F.row_number().over(peers.orderBy("item_id")) - 1
    factor = F.when(earlier == 0, 1.0).when(earlier == 1, 0.5).when(earlier == 2, 0.25).otherwise(0.1)
    age = F.greatest(F.lit(0.0), (ref - seen) / F.lit(float(HOUR)))
    rows = rows.withColumns({"base_weight": base_weight(), "time_decay": F.pow(F.lit(2.0), -age / 12), "source_repeat_factor": factor})
    return rows.withColumn("contribution", F.col("base_weight") * F.col("time_decay") * F.col("source_repeat_factor"))


def heat_contributions(mentions: DataFrame, as_of: Column) -> DataFrame:
    """Per counted message: weight, half-life decay of 12 hours, and a factor that falls
    with each earlier message of the same source within six hours."""
    return _with_contribution(_marked(mentions), as_of.cast("long")).where("_eligible").drop("_eligible", "_kept")


def event_heat(mentions: DataFrame, as_of: Column) -> DataFrame:
    """event_id, heat_raw, heat_score, heat_level, message and source counts; one grouping."""
    ref = as_of.cast("long")
    day = F.col("_kept") & F.col("seen_us").between(ref - DAY, ref)
    core = _with_contribution(_marked(mentions), ref).groupBy("event_id").agg(
        F.sum(F.when(F.col("_eligible"), F.col("contribution"))).alias("raw"), F.count("*").alias("n"), F.count_if("_kept").alias("message_count_total"),
        F.count_if(day).alias("message_count_24h"), F.countDistinct(F.when(day, F.col("source_id"))).alias("unique_sources_24h"),
    )
    score = F.round(1 - F.exp(-F.coalesce("raw", F.lit(0.0)) / 6), 6)
    return core.select(
        "event_id", F.round(F.coalesce("raw", F.lit(0.0)), 6).alias("heat_raw"), score.alias("heat_score"), level(score, V.HEAT_LEVELS).alias("heat_level"),
        "message_count_total", "message_count_24h", "unique_sources_24h", (F.col("n") - F.col("message_count_total")).alias("deduplicated_count"),
    )


# ---- credibility ----------------------------------------------------------------


def strength(role: Column, reliability: Column) -> Column:
    """0 to 100 by role, for some roles linear in the clipped reliability."""
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), reliability))
    out = F.lit(None).cast("double")
    for name, (_, low, gain) in V.SOURCE_ROLES.items():
        out = F.when(role == name, F.lit(low) + F.lit(gain) * r).otherwise(out)
    return out


def event_credibility(mentions: DataFrame) -> DataFrame:
    """Strongest voice of each independence group and polarity, folded per event."""
    counts = (F.length("independence_group") > 0) & (F.col("relation") != "mentions")
    rows = mentions.withColumn("s", strength(F.col("source_role"), F.col("reliability")))
    denies, positive = counts & (F.col("relation") == "denies"), counts & F.col("relation").isin(*V.POSITIVE_RELATIONS) & (F.col("s") > 0)
    per_group = rows.groupBy("event_id", "independence_group").agg(
        F.max(F.when(positive, F.col("s"))).alias("pos"),
        F.max(F.when(denies, F.col("s"))).alias("neg"),
        F.coalesce(F.bool_or(positive & (F.col("source_role") == "responsible_official")), F.lit(False)).alias("official"),
        F.coalesce(F.bool_or(denies & F.col("source_role").isin("responsible_official", "direct_subject")), F.lit(False)).alias("authority"),
    )
    every = per_group.groupBy("event_id").agg(
        F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.count("pos").alias("positives"), F.count("neg").alias("negatives"),
        F.count_if("official").alias("officials"), F.count_if("authority").alias("denials"), F.count_if(F.col("official") | F.col("authority")).alias("any_official"),
        F.count_if(F.col("pos").isNotNull() | F.col("neg").isNotNull()).alias("independent"),
    )
    pos, neg = F.coalesce("pos", F.lit(0.0)), F.coalesce("neg", F.lit(0.0))
    disputed = ((F.col("officials") > 0) & (F.col("denials") > 0)) | ((pos >= 70) & (neg >= 70))
    open_points = F.least(F.lit(95.0), F.greatest(F.lit(0.0), pos + 8 * F.least(F.greatest(F.col("positives") - 1, F.lit(0)), F.lit(3)) - 15 * F.least("negatives", F.lit(2))))
    points = F.when(disputed, 50.0).when(F.col("denials") > 0, 0.0).when(F.col("officials") > 0, 100.0).otherwise(open_points)
    name = (
        F.when(disputed, "disputed").when(F.col("denials") > 0, "denied").when(F.col("officials") > 0, "officially_confirmed")
        .when((F.col("positives") >= 2) & (points >= 70), "corroborated").when(points >= 40, "plausible").otherwise("unverified")
    )
    return every.select(
        "event_id", F.round(points / 100, 6).alias("credibility_score"), name.alias("credibility_level"), F.round(pos, 4).alias("strongest_positive"), F.round(neg, 4).alias("strongest_negative"),
        F.col("positives").alias("supporting_sources"), F.col("negatives").alias("contradicting_sources"), F.col("independent").alias("independent_sources"), F.col("any_official").alias("official_sources"),
    )


# ---- importance -----------------------------------------------------------------


def importance_reason() -> Column:
    """Why a mention does not count; null if it does."""
    score = F.col("importance_score")
    return (
        F.when(~F.col("materiality").eqNullSafe(F.lit("material_update")), "non_material")
        .when(score.isNull() | F.isnan(score), "missing_or_invalid_domain_score")
        .when(~score.between(0, 1), "domain_score_out_of_range")
        .when(F.col("importance_profile").isNull() | ~F.col("importance_profile").isin(*V.SCORE_BANDS), "missing_or_invalid_profile")
    )


def event_importance(mentions: DataFrame, evidence: int = 10) -> DataFrame:
    """The strongest valid material message, and the ``evidence`` leading ones."""
    rows = mentions.withColumn("reason", importance_reason())
    counts = F.col("reason").isNull()
    entry = F.struct((-F.round("importance_score", 4)).alias("neg"), "item_id", "item_revision", "mention_index", F.col("importance_profile").alias("profile"))
    # only the leading entries of each event go into its list
    rank = F.row_number().over(Window.partitionBy("event_id", counts).orderBy(F.round("importance_score", 4).desc(), "item_id", "item_revision", "mention_index"))
    folded = rows.withColumn("n", rank).groupBy("event_id").agg(
        F.count_if(counts).alias("contributions"), F.count_if(~counts).alias("ignored"), F.array_sort(F.collect_list(F.when(counts & (F.col("n") <= evidence), entry))).alias("top"),
    )
    first = F.get("top", F.lit(0))
    score = F.coalesce(-first["neg"], F.lit(0.0))
    return folded.select(
        "event_id", score.alias("importance_score"), level(score, V.IMPORTANCE_LEVELS).alias("importance_level"), first["profile"].alias("dominant_profile"), first["item_id"].alias("dominant_item_id"),
        "contributions", "ignored", F.when(F.size("top") > 0, F.array_join(F.transform("top", lambda x: x["item_id"].cast("string")), ",")).alias("evidence_items"),
    )


def importance_ignored(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("reason", importance_reason()).where("reason is not null").groupBy("event_id", "reason").agg(F.count("*").alias("n"))


# ---- times, references, lifecycle --------------------------------------------------


def _times() -> list[Column]:
    t = F.col("time_us")
    return [F.min(t).alias("first_seen_us"), F.max(t).alias("last_seen_us"), F.max(F.when(F.col("materiality") == "material_update", t)).alias("last_material_us")]


def _references() -> list[Column]:
    t, i, rank = F.col("time_us"), F.col("id"), role_rank(F.col("source_role"))
    material, positive = F.col("materiality") == "material_update", F.col("relation").isin(*V.POSITIVE_RELATIONS)
    return [
        F.min_by("item_id", F.when(material, F.struct(t, i))).alias("origin_item"),
        F.max_by("item_id", F.when(material, F.struct(t, i))).alias("latest_item"),
        F.max_by("item_id", F.when(positive, F.struct(rank.alias("r"), "reliability", (-t).alias("t"), (-i).alias("i")))).alias("primary_item"),
        F.max_by("item_id", F.when(F.col("has_media"), F.struct(rank.alias("r"), material.alias("m"), t.alias("t"), i.alias("i")))).alias("media_item"),
    ]


def event_times(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("event_id").agg(*_times())


def event_references(mentions: DataFrame) -> DataFrame:
    """Origin and latest material message, best primary source, best with media."""
    return mentions.groupBy("event_id").agg(*_references())


def restored_status(mentions: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Lifecycle before scoring: that of the newest snapshot among material mentions
    (by time, then id; late evidence never wins), else developing, else stale.
    ``snapshots`` has mention_id and lifecycle_status."""
    material = mentions.where("materiality = 'material_update'")
    if snapshots is not None:
        s = material.join(snapshots, material.id == snapshots.mention_id).groupBy("event_id").agg(F.max_by(F.coalesce("lifecycle_status", F.lit("developing")), F.struct("time_us", "id")).alias("snap"))
    base = mentions.groupBy("event_id").agg(F.bool_or(F.col("materiality") == "material_update").alias("m"))
    out = base.join(s, "event_id", "left") if snapshots is not None else base.withColumn("snap", F.lit(None).cast("string"))
    return out.select("event_id", F.coalesce("snap", F.when(F.col("m"), "developing").otherwise("stale")).alias("status"))


MENTION_KEY = ["event_id", "item_id", "item_revision", "mention_index", "policy"]


def restored_projection(events: DataFrame, mentions: DataFrame, revisions: DataFrame) -> DataFrame:
    """event_id, title, current_summary, lifecycle_status after evidence was removed: those
    of the newest snapshot whose mention is still a material one. Newest is by the
    mention's time, then its id, whatever the order of the revisions. Without a snapshot
    an event keeps its texts and is developing if it has a material mention, else stale.
    ``revisions``: event_id, the mention's key and snapshot (a struct, may be null)."""
    material = mentions.where("materiality = 'material_update'").groupBy(*MENTION_KEY).agg(F.max("id").alias("id"), F.max_by("time_us", "id").alias("time_us"))
    held = revisions.where("snapshot is not null").join(material, MENTION_KEY)
    newest = held.groupBy("event_id").agg(F.max_by("snapshot", F.struct("time_us", "id", F.col("snapshot.title"))).alias("s"))
    has = mentions.groupBy("event_id").agg(F.bool_or(F.col("materiality") == "material_update").alias("material"))
    rows = events.join(newest, "event_id", "left").join(has, "event_id", "left")
    own = lambda c: F.coalesce(F.when(F.length(f"s.{c}") > 0, F.col(f"s.{c}")), F.col(c)).alias(c)
    status = F.when(F.col("s").isNotNull(), F.coalesce("s.lifecycle_status", F.lit("developing"))).when(F.coalesce("material", F.lit(False)), "developing").otherwise("stale")
    return rows.select("event_id", own("title"), own("current_summary"), status.alias("lifecycle_status"))


def lifecycle(status: Column, credibility_level: Column) -> Column:
    return (
        F.when((credibility_level == "officially_confirmed") & status.isin("unconfirmed", "developing", "disputed", "stale"), "confirmed")
        .when(credibility_level == "denied", "denied")
        .when(credibility_level == "disputed", "disputed")
        .when(status.isin("confirmed", "denied", "disputed"), "developing")
        .otherwise(status)
    )


def event_lifecycle(mentions: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    joined = restored_status(mentions, snapshots).join(event_credibility(mentions).select("event_id", "credibility_level"), "event_id")
    return joined.select("event_id", lifecycle(F.col("status"), F.col("credibility_level")).alias("lifecycle"))


def refresh_event_metrics(mentions: DataFrame, as_of: Column, snapshots: DataFrame | None = None) -> DataFrame:
    """The gold row of every event: scores, levels, counts, times and references.

    Times, references, importance and counts are one aggregation with partial sums
    before its shuffle; heat and credibility, which group twice, are two more. The
    mentions are read once per group, so callers whose mentions are themselves a join
    should materialise them first."""
    score, counts = F.round("importance_score", 4), importance_reason().isNull()
    best = F.max_by(F.struct(score.alias("s"), F.col("importance_profile").alias("p"), F.col("item_id").alias("i")), F.when(counts, F.struct(score.alias("s"), (-F.col("item_id")).alias("i"), (-F.col("item_revision")).alias("r"), (-F.col("mention_index")).alias("m"))))
    material = F.col("materiality") == "material_update"
    base = mentions.groupBy("event_id").agg(
        *_times(), *_references(), F.count_if(counts).alias("contributions"), F.count_if(~counts).alias("ignored"), best.alias("_best"), F.bool_or(material).alias("_material"),
    )
    value = F.coalesce("_best.s", F.lit(0.0))
    base = base.withColumns({"importance_score": value, "importance_level": level(value, V.IMPORTANCE_LEVELS), "dominant_profile": F.col("_best.p"), "dominant_item_id": F.col("_best.i")}).drop("_best")
    out = base.join(event_heat(mentions, as_of), "event_id").join(event_credibility(mentions), "event_id")
    status = F.when(F.col("_material"), "developing").otherwise("stale")
    if snapshots is not None:
        own = mentions.where(material).join(snapshots, mentions.id == snapshots.mention_id)
        restored = own.groupBy("event_id").agg(F.max_by(F.coalesce("lifecycle_status", F.lit("developing")), F.struct("time_us", "id")).alias("_snap"))
        out = out.join(restored, "event_id", "left")
        status = F.coalesce("_snap", status)
    return out.withColumn("lifecycle", lifecycle(status, F.col("credibility_level"))).drop("_material", "_snap")
