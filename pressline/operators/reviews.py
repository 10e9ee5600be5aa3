"""Review corrections, legal labels, children of messages, alerts and small label rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import vocab as V
from pressline.functions.text import clip, strip
from pressline.operators.detail import ALLOWED
from pressline.operators.messages import classification_error, content_error

CORRECTED = ("decision", "products", "content_form", "message_type", "topics", "importance_score")


def corrected_proposals(reviews: DataFrame) -> DataFrame:
    """``reviews`` with error and, where there is none, the proposal after its corrections
    (final_decision, final_products, ...), final_score, computed_score and override.

    ``reviews`` has id, stage, the proposal (``CORRECTED``, title, summary, n_entities and
    computed_score), the corrections (the same names with new_; null: not corrected), the
    approved analysis (analysis_products, analysis_form) and source_kind. A correction
    must be of a field that the stage allows; corrected analyses and labels are checked by the
    rules that hold for computed ones; a corrected score overrides the computed one, which is kept."""
    new = {c: F.col(f"new_{c}") for c in CORRECTED}
    final = {c: F.coalesce(new[c], F.col(c)) for c in CORRECTED}
    given = F.array_compact(F.array(*(F.when(x.isNotNull(), c) for c, x in new.items())))
    allowed = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    odd = F.array_sort(F.array_except(given, F.coalesce(F.try_element_at(allowed, F.col("stage")), F.array().cast("array<string>"))))
    labels = (F.col("stage") == "importance") & (new["message_type"].isNotNull() | new["topics"].isNotNull())
    said = classification_error(F.col("analysis_products"), F.col("analysis_form"), final["message_type"], final["topics"], F.col("source_kind"))
    error = (
        F.when(F.size(odd) > 0, F.concat(F.lit("unsupported: "), F.array_join(odd, ", ")))
        .when(F.col("stage") == "message_analysis", content_error(final["products"], final["content_form"], F.col("title"), F.col("summary"), F.col("n_entities")))
        .when(labels & F.col("analysis_products").isNull(), "no approved analysis").when(labels & ~F.coalesce(F.col("source_kind").isin(*V.SOURCE_KINDS), F.lit(False)), "no source kind")
        .when(labels, said)
    )
    rows = reviews.withColumn("error", error)
    ok = F.col("error").isNull()
    override = (F.col("stage") == "importance") & new["importance_score"].isNotNull()
    computed = F.when(override, F.coalesce("computed_score", "importance_score"))
    return rows.withColumns({**{f"final_{c}": F.when(ok, x) for c, x in final.items() if c != "importance_score"}, "final_score": F.when(ok, final["importance_score"]), "override": ok & override, "kept_score": F.when(ok, computed)})


# ---- labels


def legal_labels(products: Column, source_kind: Column) -> Column:
    """(types, topics) that a product set and a source side allow, in catalogue order."""
    types = F.array(*(F.struct(F.lit(t).alias("code"), F.array(*map(F.lit, ps)).alias("products"), F.lit(s).alias("side")) for t, ps, s in V.MESSAGE_TYPES))
    topics = F.array(*(F.struct(F.lit(t).alias("code"), F.array(*map(F.lit, ps)).alias("products")) for t, ps, _ in V.TOPICS))
    fits = lambda x: (x["code"] == "unknown") | F.arrays_overlap(x["products"], products)
    side = lambda x: (x["code"] == "unknown") | (source_kind == "unknown") | (x["side"] == "any") | (x["side"] == source_kind)
    code = lambda xs: F.transform(xs, lambda x: x["code"])
    return F.struct(code(F.filter(types, lambda x: fits(x) & side(x))).alias("types"), code(F.filter(topics, fits)).alias("topics"))


def ordered_topics(topics: Column) -> Column:
    """The topics that the catalogue knows, once each, in its order."""
    return F.filter(F.array(*map(F.lit, V.TOPIC_ORDER)), lambda t: F.array_contains(topics, t))


def first_text(*fields: Column) -> Column:
    """The first of the fields that says something, trimmed; else empty."""
    return F.coalesce(*(F.nullif(strip(f), F.lit("")) for f in fields), F.lit(""))


def claim_fingerprint(family: Column, product: Column, excerpt: Column) -> Column:
    """sha256 of a claim as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(excerpt.alias("excerpt"), family.alias("family"), product.alias("product")), {"ignoreNullFields": "false"}), 256)


def has_type(message_type: Column, wanted: str) -> Column:
    """Messages of a type; the word null stands for those without one."""
    return message_type.isNull() if wanted == "null" else F.coalesce(message_type == wanted, F.lit(False))


# ---- children


def with_children(items: DataFrame, sources: DataFrame, assets: DataFrame, links: DataFrame) -> DataFrame:
    """``items`` (id, source_id, ...) with source (id, name, connector_type), media (by
    block index and id) and links (by position): each child table is grouped once and
    joined by the message, so that a page of details costs three joins and no loop.
    ``assets``: asset_id, raw_item_id, block_index, public_path, mime_type; ``links``: item_id,
    position, url, label."""
    one = sources.select(F.col("id").alias("source_id"), F.struct("id", "name", "connector_type").alias("source"))
    media = assets.groupBy(F.col("raw_item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("block_index", "asset_id", "public_path", "mime_type"))).alias("media"))
    named = links.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "url", "label"))).alias("links"))
    none = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType)).alias(c)
    joined = items.join(one, "source_id", "left").join(media, "id", "left").join(named, "id", "left")
    return joined.select(*items.columns, "source", none("media", media), none("links", named))


# ---- alerts

# Names of stages and kinds of errors on alerts, and lengths of their parts.
STAGE_LABELS = {"relevance": "相关性判断", "ocr": "图片识别", "translation": "翻译", "analysis": "内容分析", "importance": "重要性评估", "publish": "发布"}
ERROR_LABELS = {"authentication": "登录失效", "configuration": "配置错误", "rate_limited": "请求限流", "upstream_rejected": "上游拒绝", "collection_failed": "采集失败"}
SOURCE_NAME, CONNECTOR, MOMENT, SUMMARY = 120, 60, 80, 1200


def _shown(x: Column, most: int) -> Column:
    return F.coalesce(F.nullif(clip(strip(x.cast("string")), most), F.lit("")), F.lit("-"))


def alert_lines(alerts: DataFrame) -> DataFrame:
    """id, title, details (array of lines), summary of failures. ``alerts``: id, kind
    (collection_failure or pipeline_failure), source_name, connector_type, source_id,
    error_kind, failures, run_id, stage, raw_item_id, job_id, checkpoint_id, occurred_at, error_summary."""
    label = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c)), F.col(c), F.lit("-"))
    line = lambda name, value: F.concat(F.lit(f"{name}："), value)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    source, at = line("来源", _shown(F.col("source_name"), SOURCE_NAME)), line("发生时间", _shown(F.col("occurred_at"), MOMENT))
    collection = F.array(source, line("connector_type", _shown(F.col("connector_type"), CONNECTOR)), line("source_id", text("source_id")), line("错误类别", label(ERROR_LABELS, "error_kind")), line("连续失败", text("failures")), line("run", text("run_id")), at)
    pipeline = F.array(line("阶段", label(STAGE_LABELS, "stage")), line("raw_item", text("raw_item_id")), line("job", text("job_id")), line("run", text("run_id")), source, line("checkpoint", text("checkpoint_id")), at)
    kind = F.col("kind")
    return alerts.select("id", F.when(kind == "collection_failure", "采集失败").when(kind == "pipeline_failure", "处理失败").alias("title"), F.when(kind == "collection_failure", collection).when(kind == "pipeline_failure", pipeline).alias("details"), _shown(F.col("error_summary"), SUMMARY).alias("summary")).where("title is not null")


def alert_cards(alerts: DataFrame, sender: str = "") -> DataFrame:
    """id, body: the JSON of each alert's card, headed by the sender's name."""
    md = lambda text: F.struct(F.lit("div").alias("tag"), F.struct(F.lit("lark_md").alias("tag"), text.alias("content")).alias("text"))
    rule = F.struct(F.lit("hr").alias("tag"), F.lit(None).cast("struct<tag:string,content:string>").alias("text"))
    elements = F.array(md(F.array_join("details", "\n")), rule, md(F.concat(F.lit("**错误摘要**\n"), "summary")))
    title = F.trim(F.concat(F.lit(f"🚨 {sender} "), F.col("title")))
    header = F.struct(F.lit("red").alias("template"), F.struct(F.lit("plain_text").alias("tag"), title.alias("content")).alias("title"))
    card = F.struct(F.struct(F.lit(True).alias("wide_screen_mode")).alias("config"), header.alias("header"), elements.alias("elements"))
    return alert_lines(alerts).select("id", F.to_json(F.struct(F.lit("interactive").alias("msg_type"), card.alias("card"))).alias("body"))
