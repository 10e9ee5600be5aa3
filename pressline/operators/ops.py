"""Operational metrics, knowledge checks, source policies and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import text as T
from pressline.operators.detail import platform_identity


def job_metrics(jobs: DataFrame) -> DataFrame:
    """One row per (stage, status) with counts, retries and the oldest queued job."""
    return jobs.groupBy("stage", "status").agg(F.count("*").alias("n"), F.sum("recovery_count").alias("recovered"), F.min(F.when(F.col("status") == "queued", F.col("created_us"))).alias("oldest_queued_us"))


def batch_status(ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """Histogram of the latest job's status of each id, with 'missing'."""
    latest = jobs.groupBy(F.col("raw_item_id").alias("id")).agg(F.max_by("status", "id").alias("status"))
    return ids.join(latest, "id", "left").groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def review_stages(jobs: DataFrame) -> DataFrame:
    """Distinct stages of each raw item in the order they were first seen."""
    first = jobs.groupBy("raw_item_id", "stage").agg(F.min("id").alias("id"))
    return first.groupBy("raw_item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "stage"))), lambda x: x["stage"]), ",").alias("stages"))


def knowledge_conflicts(rules: DataFrame) -> DataFrame:
    """Active rules of one scope and key that say different things."""
    said = F.regexp_replace(F.lower(F.trim("rule_text")), r"\s+", " ")
    rows = rules.where("active and length(trim(constraint_key)) > 0").withColumns({"k": F.lower(F.trim("constraint_key")), "said": said})
    found = rows.groupBy("scope", F.col("k").alias("constraint_key")).agg(F.countDistinct("said").alias("texts"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return found.where("texts > 1")


def reliability(connector: Column, key: Column, name: Column) -> Column:
    """Calibrated reliability of a source; accounts, name parts and values are fixed."""
    official = connector.isin("riot_official", "tencent_lol") | F.lower(F.coalesce(key, F.lit(""))).isin("leagueoflegends", "lolesports", "5756404150", "5720474518")
    n = F.lower(name)
    return (
        F.when(official, 1.0).when(n.like("%skinspotlights%") | n.like("%spideraxe%"), 0.8).when(n.like("%召唤师park%") | n.like("%尧阿尧%") | n.like("%riotphroxzon%"), 0.75)
        .when(connector.isin("weibo", "x_twitter", "baidu_tieba"), 0.55).otherwise(0.5)
    )


def independence_group(content_form: Column, source_id: Column, upstream: Column) -> Column:
    url = T.upstream_url(upstream)
    return F.when(content_form == "repost", F.when(url.isNotNull(), F.concat(F.lit("upstream:"), url))).otherwise(F.concat(F.lit("source:"), source_id.cast("string")))


def verified_role(role: Column, content_form: Column, is_official: Column) -> Column:
    return F.when(role != "responsible_official", role).when(content_form == "repost", "republisher").when(~is_official, "unknown").otherwise(role)


def classification_source(messages: DataFrame, sites: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """id, source_kind, basis. A repost takes the side of its upstream. An upstream that
    names an account of a platform is looked up among ``accounts`` (connector_type,
    external_key, official; case does not count), any other among ``sites`` (site, official)
    by its host or a parent of it. With no or several matches the side is unknown. Parent
    hosts are spelled out, so that the suffix match is an equality join, too.
    ``messages``: id, content_form, is_official, upstream."""
    m = messages.withColumn("h", F.regexp_replace(T.host(T.classification_url(F.col("upstream"))), r"^www\.", "")).withColumn("account", platform_identity(T.classification_url(F.col("upstream"))))
    reposts = m.where("content_form = 'repost'")
    if accounts is None:
        reposts = reposts.withColumn("account", F.lit(None).cast("struct<connector_type:string,external_key:string>"))
    parts = F.split("h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = reposts.where("length(h) > 0 and account is null").select("id", F.explode(parents).alias("site"))
    sides = hosts.join(sites, "site").select("id", "official")
    if accounts is not None:
        key = lambda c: F.lower(F.col(c)).alias("key")
        named = reposts.where("account is not null").select("id", "account.connector_type", key("account.external_key"))
        sides = sides.unionByName(named.join(accounts.select("connector_type", key("external_key"), "official"), ["connector_type", "key"]).select("id", "official"))
    hit = sides.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("official").alias("up"))
    joined = m.join(hit.where("n = 1"), "id", "left")
    kind = lambda c: F.when(c, "official").otherwise("unofficial")
    repost = F.col("content_form") == "repost"
    return joined.select(
        "id", F.when(~repost, kind(F.col("is_official"))).when(F.col("up").isNull(), "unknown").otherwise(kind(F.col("up"))).alias("source_kind"),
        F.when(~repost, "current").when(F.col("up").isNull(), "unresolved").otherwise("upstream").alias("basis"),
    )


def accuracy(labels: DataFrame) -> DataFrame:
    """Exact matches overall and by task: task, expected, actual (null: no prediction)."""
    match = F.count_if(F.col("expected") == F.col("actual")).alias("matched")
    total = labels.rollup("task").agg(F.count("*").alias("total"), match, F.count_if(F.col("actual").isNull()).alias("missing"), F.grouping_id().alias("g"))
    return total.select(F.when(F.col("g") == 1, "all").otherwise(F.col("task")).alias("task"), "total", "matched", "missing", F.round(F.col("matched") / F.col("total"), 6).alias("accuracy"))


def membership_outcome(expected: Column, predicted: Column) -> Column:
    """(missing, extra) of a greedy multiset match of memberships (arrays of structs
    action, event_key, event_family, relation), in the order expected; a null family
    or relation of the expectation matches anything."""
    start = F.struct(predicted.alias("left"), F.lit(0).alias("missing"))

    def step(acc, e):
        same = lambda p: F.coalesce(
            (p["action"] == e["action"]) & (p["event_key"] == e["event_key"]) & (e["event_family"].isNull() | (p["event_family"] == e["event_family"])) & (e["relation"].isNull() | (p["relation"] == e["relation"])), F.lit(False)
        )
        at = F.array_position(F.transform(acc["left"], same), True)
        rest = F.concat(F.slice(acc["left"], F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), F.slice(acc["left"], at.cast("int") + 1, F.size(acc["left"])))
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), (acc["missing"] + F.when(at > 0, 0).otherwise(1)).alias("missing"))

    return F.aggregate(expected, start, step, lambda acc: F.struct(acc["missing"].alias("missing"), F.size(acc["left"]).alias("extra")))


def membership_totals(items: DataFrame) -> DataFrame:
    """One row of counts over messages (expected, predicted: arrays of memberships;
    predicted null: no prediction): exact and mismatching messages, missed and extra
    memberships, messages without a prediction."""
    nothing = F.expr("cast(array() as array<struct<action:string,event_key:string,event_family:string,relation:string>>)")
    o = items.select(membership_outcome(F.col("expected"), F.coalesce("predicted", nothing)).alias("o"), F.col("predicted").isNull().alias("none"))
    missing, extra = F.col("o.missing"), F.col("o.extra")
    return o.agg(
        F.count("*").alias("item_count"), F.count_if((missing + extra) == 0).alias("exact"), F.count_if((missing + extra) > 0).alias("mismatch"),
        F.sum(missing.cast("long")).alias("missed_membership"), F.sum(extra.cast("long")).alias("extra_membership"), F.count_if("none").alias("missing_prediction"),
    )


def evidence_projection(mentions: DataFrame) -> DataFrame:
    """Distinct and filtered aggregates of an event's evidence."""
    material = F.col("materiality") == "material_update"
    return mentions.groupBy("event_id").agg(
        F.countDistinct(F.when(F.col("relation") == "denies", F.col("independence_group"))).alias("denying_groups"),
        F.countDistinct(F.when(F.col("relation").isin("reports", "supports", "confirms", "corrects"), F.col("independence_group"))).alias("supporting_groups"),
        F.coalesce(F.bool_or(F.col("source_role") == "responsible_official"), F.lit(False)).alias("has_official"), F.max(F.when(material, F.col("time_us"))).alias("material_us"),
    )


def next_run(now_us: Column, enabled: Column, succeeded: Column, truncated: Column, interval_min: Column, retry_min: Column, truncated_min: int = 1) -> Column:
    """When a collection schedule is due again: soon after a truncated fetch, at its
    interval after a whole one, at its retry delay after a failure; never if disabled."""
    delay = F.when(succeeded, F.when(truncated, F.lit(truncated_min)).otherwise(interval_min)).otherwise(retry_min)
    return F.when(enabled, now_us + delay * 60_000_000)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, as one result."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
