"""Details of published messages, knowledge rules, notifications and review: what the
read side adds to a message, and what the workflow checks before it changes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.text import strip

# ---- media of published messages ------------------------------------------------------


def public_media_path(path: Column) -> Column:
    """Is a storage path served without authentication?"""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(path.startswith("/media/") & ~plain.contains("/private/"), F.lit(False))


def media_by_block(assets: DataFrame) -> DataFrame:
    """id, public, stored: maps from block index to the path that a message's media have
    there; of several assets of a block the last one counts. ``assets``: asset_id,
    raw_item_id, block_index, public_path, storage_path."""
    has_public = F.length("public_path") > 0
    last = assets.groupBy("raw_item_id", "block_index").agg(
        F.max_by("public_path", F.when(has_public, F.col("asset_id"))).alias("public"),
        F.max_by("storage_path", F.when(~F.coalesce(has_public, F.lit(False)) & public_media_path(F.col("storage_path")), F.col("asset_id"))).alias("stored"),
    )
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("block_index").cast("int"), F.col(c))))).alias(c)
    return last.groupBy(F.col("raw_item_id").alias("id")).agg(entry("public"), entry("stored"))


def public_blocks(blocks: Column, public: Column, stored: Column) -> Column:
    """Blocks (type, text, storage_path) as readers see them: images with the published
    path of their index, else a servable stored one, else their own if it is servable;
    other blocks without any path."""
    at = lambda m, i: F.element_at(F.coalesce(m, F.create_map().cast("map<int,string>")), i)

    def one(b, i):
        own = F.when(public_media_path(b["storage_path"]), b["storage_path"])
        return F.struct(b["type"].alias("type"), b["text"].alias("text"), F.when(b["type"] == "image", F.coalesce(at(public, i), at(stored, i), own)).alias("storage_path"))

    return F.transform(blocks, one)


# ---- knowledge rules and glossary -------------------------------------------------------


def scoped_rules(sources: DataFrame, rules: DataFrame, limit: int = 100) -> DataFrame:
    """source_id, position, rule_id, text: the newest active rules of the scopes global,
    connector:type and source:id of each source. ``rules``: id, scope, version,
    rule_text, active, updated_us; ``sources``: id, connector_type."""
    scopes = F.array(F.lit("global"), F.concat(F.lit("connector:"), "connector_type"), F.concat(F.lit("source:"), F.col("id").cast("string")))
    wanted = sources.select(F.col("id").alias("source_id"), F.explode(scopes).alias("scope"))
    # the newest of each scope are enough, which bounds what a frequent scope brings to each source
    newest = Window.partitionBy("scope").orderBy(F.col("updated_us").desc(), F.col("id").desc())
    few = rules.where("active").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n")
    order = Window.partitionBy("source_id").orderBy(F.col("updated_us").desc(), F.col("id").desc())
    found = wanted.join(few, "scope").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    text = F.concat(F.lit("["), "scope", F.lit(" v"), F.col("version").cast("string"), F.lit("] "), "rule_text")
    return found.select("source_id", "position", F.col("id").alias("rule_id"), text.alias("text"))


def glossary_hits(messages: DataFrame, terms: DataFrame, limit: int = 500) -> DataFrame:
    """id, term, translation: the terms that occur in each text, whatever their case. At
    most ``limit`` active terms, the newest, are looked for; so few go into the plan as
    a literal, and there is no join. ``terms``: term, translation, active, updated_us."""
    newest = terms.where("active").orderBy(F.col("updated_us").desc(), "term").limit(limit).collect()
    if not newest:
        return messages.select("id", F.lit("").alias("term"), F.lit("").alias("translation")).limit(0)
    known = F.array(*(F.struct(F.lit(t["term"]).alias("term"), F.lit(t["translation"]).alias("translation")) for t in newest))
    lowered = messages.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    hits = F.filter(known, lambda t: (F.col("text") == "") | F.contains(F.col("text"), F.lower(t["term"])))
    return lowered.select("id", F.explode(hits).alias("t")).select("id", "t.term", "t.translation")


# ---- notifications ------------------------------------------------------------------------


def clip_or(x: Column, n: int, fallback: str | None = "-") -> Column:
    """Trimmed text cut to n characters and an ellipsis; the fallback for nothing."""
    text = strip(F.coalesce(x, F.lit("")))
    return F.when(text == "", F.lit(fallback)).when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def featured_payload(items: DataFrame, origin: str = "") -> DataFrame:
    """What a push of a featured message holds; lengths and counts are fixed values. ``items``: id, status, content_form,
    importance_score, title, translated_title, summary, source_name, connector_type,
    products, message_type, topics, author, seen_us."""
    featured = (F.col("status") == "published") & (F.col("importance_score") >= 0.75) & (F.col("content_form") != "repost")
    title = F.when(F.length("translated_title") > 0, F.col("translated_title")).otherwise(F.col("title"))
    return items.where(featured).select(
        F.col("id").alias("normalized_item_id"), clip_or(title, 300).alias("title"), clip_or(F.col("summary"), 1000).alias("summary"), clip_or(F.col("source_name"), 120).alias("source_name"),
        clip_or(F.col("connector_type"), 60).alias("connector_type"), F.slice("products", 1, 3).alias("products"), clip_or(F.col("message_type"), 80).alias("message_type"),
        F.round("importance_score", 4).alias("importance_score"), F.col("seen_us").alias("published_us"), clip_or(F.col("author"), 120, "").alias("author_name"),
        F.slice("topics", 1, 5).alias("topics"), F.when(F.lit(origin) != "", F.concat(F.lit(origin + "/messages/"), F.col("id").cast("string"))).alias("url"),
    )


def recently_sent(outbox: DataFrame, prefix: str, now_us: int, cooldown_s: int) -> DataFrame:
    """Notifications of a key prefix within the cool-down that were not given up."""
    recent = F.col("created_us") >= now_us - cooldown_s * 1_000_000
    return outbox.where(F.col("dedupe_key").startswith(prefix) & recent & F.col("status").isin("pending", "sending", "failed", "sent"))


# ---- candidates ------------------------------------------------------------------------------

OPTIONAL = ("native_title", "canonical_url", "author_name", "language", "external_id")


def validated_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with optional texts trimmed (nothing becomes null) and ``error``: what
    is wrong with one, or null. ``candidates``: the OPTIONAL texts, published_at (text)
    and n_blocks."""
    text = {c: F.when(strip(F.col(c)) != "", strip(F.col(c))) for c in OPTIONAL}
    trimmed = candidates.withColumns(text)
    zoned = F.col("published_at").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    error = (
        F.when(F.col("n_blocks") <= 0, "no content blocks")
        .when(~F.col("canonical_url").rlike(r"^(?i:https?)://[^/?#]"), "url must be absolute")
        .when(~zoned, "time needs a zone")
    )
    return trimmed.withColumn("error", error)


def platform_identity(url: Column) -> Column:
    """(connector_type, external_key) of an account's URL on a known platform, else null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    account = lambda kind, key: F.struct(F.lit(kind).alias("connector_type"), key.alias("external_key"))
    return F.when(host.isin("x.com", "twitter.com") & first.isNotNull(), account("x_twitter", first)).when(
        (host == "weibo.com") & first.isNotNull(), account("weibo", F.when((first == "u") & second.isNotNull(), second).otherwise(first))
    )


# ---- work that is due, stages and restarts -----------------------------------------------------

# The stages in order, the checkpoint that each restart builds on, and the fields
# that a correction of a stage may change.
STAGES = ("relevance", "ocr", "translation", "analysis", "importance", "publish")
BEFORE = {"ocr": "relevance", "translation": "ocr", "analysis": "translation", "importance": "analysis"}


def claimable(jobs: DataFrame, now_us: int, attempts: int = 4) -> DataFrame:
    """Jobs that a worker may take: queued, failed and due again, or running with a lease
    that is over; never those without attempts left. Oldest first is the caller's order."""
    over = lambda c: F.col(c).isNull() | (F.col(c) <= now_us)
    due = (F.col("status") == "queued") | ((F.col("status") == "failed") & (F.col("next_attempt_us") <= now_us)) | ((F.col("status") == "running") & over("lease_us"))
    return jobs.where(due & (F.col("attempts") < attempts))


def stale_events(events: DataFrame, as_of_us: int, ttl_s: int = 300, limit: int = 100) -> DataFrame:
    """The events whose scores are to be computed again: never computed first, then the oldest."""
    old = F.col("calculated_us").isNull() | (F.col("calculated_us") <= as_of_us - ttl_s * 1_000_000)
    return events.where(old).orderBy(F.col("calculated_us").asc_nulls_first(), "id").limit(limit)


def next_stage(checkpoints: DataFrame) -> DataFrame:
    """raw_item_id, done, next: how many stages in a row have a valid checkpoint, and the
    stage that comes then (null at the end). ``checkpoints``: raw_item_id, stage, invalidated_us."""
    valid = checkpoints.where("invalidated_us is null").groupBy("raw_item_id").agg(F.collect_set("stage").alias("stages"))
    every = checkpoints.select("raw_item_id").distinct().join(valid, "raw_item_id", "left")
    order = F.array(*map(F.lit, STAGES))
    missing = F.filter(order, lambda s: ~F.array_contains(F.coalesce("stages", F.array().cast("array<string>")), s))
    following = F.get(missing, F.lit(0))
    done = F.when(following.isNull(), F.lit(len(STAGES))).otherwise(F.array_position(order, following).cast("int") - 1)
    return every.select("raw_item_id", done.alias("done"), following.alias("next"))


def restart_from(checkpoints: DataFrame, stage: str) -> DataFrame:
    """raw_item_id, checkpoint_id: the latest valid checkpoint that a restart at the stage builds on."""
    before = BEFORE.get(stage)
    valid = checkpoints.where((F.col("stage") == F.lit(before)) & F.col("invalidated_us").isNull())
    return valid.groupBy("raw_item_id").agg(F.max("id").alias("checkpoint_id"))


#: Fixed values, see above.
ALLOWED = {"relevance": ("decision",), "message_analysis": ("products", "content_form"), "importance": ("message_type", "topics", "importance_score")}


def correction_outcome(stage: Column, fields: Column, computed: Column, override: Column) -> Column:
    """(unsupported, final_score) of a review correction: fields that the stage does not
    allow, by name; and the score that holds afterwards."""
    allowed = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    unsupported = F.array_sort(F.array_except(fields, F.coalesce(allowed[stage], none)))
    final = F.when((stage == "importance") & F.array_contains(fields, "importance_score"), override).otherwise(computed)
    return F.struct(unsupported.alias("unsupported"), F.when(F.size(unsupported) == 0, final).alias("final_score"))


def mention_groups_in_order(decisions: DataFrame) -> DataFrame:
    """item_id, item_revision, policy, in_order: do the mentions of a message number from
    zero without gap or repeat?"""
    grouped = decisions.groupBy("item_id", "item_revision", "policy").agg(F.count("*").alias("n"), F.countDistinct("mention_index").alias("d"), F.min("mention_index").alias("lo"), F.max("mention_index").alias("hi"))
    return grouped.select("item_id", "item_revision", "policy", ((F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("in_order"))


# ---- patch previews ---------------------------------------------------------------------------------

#: section type -> label, type of its targets (fixed values).
SECTIONS = {
    "champion_buff": ("英雄增强", "champion"),
    "champion_nerf": ("英雄削弱", "champion"),
    "champion_adjustment": ("英雄调整", "champion"),
    "system_buff": ("系统增强", "system"),
    "system_nerf": ("系统削弱", "system"),
    "system_adjustment": ("系统调整", "system"),
}


#: Title of a preview without one (fixed value).
UNTITLED = "Patch Preview"


def section_type(given: Column, label: Column) -> Column:
    """A legal section type: the given one, or what the label says; null if neither."""
    letters = F.regexp_replace(F.upper(F.coalesce(label, F.lit(""))), "[^A-Z]", "")
    scope = F.when(letters.contains("CHAMPION"), "champion").when(letters.contains("SYSTEM"), "system").otherwise("")
    way = F.when(letters.contains("ADJUST"), "adjustment").when(letters.contains("BUFF"), "buff").when(letters.contains("NERF"), "nerf").otherwise("")
    said = F.concat(scope, F.lit("_"), way)
    return F.when(given.isin(*SECTIONS), given).when(said.isin(*SECTIONS), said)


def preview_entries(documents: DataFrame) -> DataFrame:
    """id, patch, title, section, section_type, label, target, target_type, changes: the
    entries of patch previews. ``documents``: id, title, sections (array of section_type,
    label, records (array of target, raw_changes))."""
    titles = F.filter(F.transform(F.split(F.replace(F.coalesce("title", F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    title = F.coalesce(F.get(titles, F.lit(0)), F.lit(UNTITLED))
    patch = F.regexp_extract(title, r"\b(\d{1,2}\.\d{1,2})\b", 1)
    rows = documents.select("id", title.alias("title"), F.posexplode("sections").alias("section", "s"))
    kind = section_type(F.col("s.section_type"), F.col("s.label"))
    rows = rows.select("id", "title", "section", kind.alias("section_type"), F.explode("s.records").alias("r"))
    fixed = lambda i: F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v[i]))))[F.col("section_type")]
    changes = F.filter(F.transform(F.coalesce("r.raw_changes", F.array().cast("array<string>")), strip), lambda x: x != "")
    return rows.select(
        "id", F.when(patch != "", patch).alias("patch"), "title", "section", "section_type", fixed(0).alias("label"), strip(F.col("r.target")).alias("target"), fixed(1).alias("target_type"), changes.alias("changes"),
    )
