"""Connectors by type: each turns a platform's recorded answers into canonical candidates.
Fetching is not part of this library; what was fetched comes as a frame of JSON or pages.

``collect`` is the one way in: it checks that the source is of the connector's type and
that the options are known, maps every record, judges the candidates and says where the
next fetch begins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import urls as U
from pressline.functions import variants as V
from pressline.functions.text import strip
from pressline.sources import official, platforms

BLOCK = {"type": "string", "text": "string", "level": "int", "items": "array<string>", "ordered": "boolean", "source_url": "string", "mime_type": "string", "alt_text": "string", "caption": "string", "embed_kind": "string"}
BLOCKS = f"array<struct<{','.join(f'{n}:{t}' for n, t in BLOCK.items())}>>"
FIELDS = ("external_id", "native_title", "canonical_url", "content_kind", "author_name", "language", "published_us", "blocks", "provenance", "skipped", "error")


def _blocks(column: str, have: tuple[str, ...]) -> Column:
    """Blocks with all fields of ``BLOCK``, those that the map does not know null."""
    return F.transform(column, lambda b: F.struct(*((b[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in BLOCK.items())))


def _us(x: str) -> Column:
    return F.unix_micros(F.col(x))


def _x_twitter(records: DataFrame) -> DataFrame:
    t = platforms.tweets(records)
    return t.select("external_id", F.lit(None).cast("string").alias("native_title"), F.col("url").alias("canonical_url"), F.lit("post").alias("content_kind"), F.col("author").alias("author_name"), F.col("lang").alias("language"), _us("published_at").alias("published_us"), _blocks("blocks", platforms._FIELDS).alias("blocks"), F.col("response").alias("provenance"), F.lit(False).alias("skipped"), F.when(F.col("rejected"), "tweet has no text").alias("error"))


def _weibo(records: DataFrame) -> DataFrame:
    t = platforms.weibo_posts(records)
    return t.select("external_id", F.lit(None).cast("string").alias("native_title"), F.col("url").alias("canonical_url"), F.lit("post").alias("content_kind"), F.col("author").alias("author_name"), F.lit("zh-CN").alias("language"), _us("published_at").alias("published_us"), _blocks("blocks", platforms._FIELDS).alias("blocks"), F.col("response").alias("provenance"), F.lit(False).alias("skipped"), F.when(F.col("rejected"), "post lacks id, author or text").alias("error"))


def _tieba(records: DataFrame) -> DataFrame:
    """``records``: conv_id, turn, role, text; a thread is one candidate with a heading and a paragraph a floor."""
    t = platforms.thread_floors(records)
    return t.select(F.col("conv_id").cast("string").alias("external_id"), F.lit(None).cast("string").alias("native_title"), F.concat(F.lit("https://tieba.baidu.com/p/"), F.col("conv_id").cast("string")).alias("canonical_url"), F.lit("thread").alias("content_kind"), F.lit(None).cast("string").alias("author_name"), F.lit("zh-CN").alias("language"), F.lit(None).cast("long").alias("published_us"), _blocks("blocks", ("type", "text", "level")).alias("blocks"), F.lit(None).cast("string").alias("provenance"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("error"))


def _riot_official(records: DataFrame) -> DataFrame:
    """``records``: page_id, url, html of article pages."""
    t = official.articles(records)
    return t.select("external_id", F.col("title").alias("native_title"), "canonical_url", F.lit("article").alias("content_kind"), F.col("author").alias("author_name"), F.lit("en").alias("language"), "published_us", _blocks("blocks", tuple(BLOCK)).alias("blocks"), F.lit(None).cast("string").alias("provenance"), F.lit(False).alias("skipped"), "error")


def _tencent_lol(records: DataFrame) -> DataFrame:
    """``records``: answer_id, value, discovery, html of article answers."""
    t = official.envelope_articles(records)
    return t.select(F.coalesce(F.nullif("docid", F.lit("")), F.col("answer_id").cast("string")).alias("external_id"), F.col("title").alias("native_title"), "canonical_url", F.lit("article").alias("content_kind"), F.col("author").alias("author_name"), F.lit("zh-CN").alias("language"), "published_us", _blocks("blocks", tuple(BLOCK)).alias("blocks"), F.col("response").alias("provenance"), F.col("missing").alias("skipped"), "error")


def _manual(records: DataFrame) -> DataFrame:
    """``records``: value, the JSON of a submission; fields of another type than text are left out."""
    v = F.try_parse_json("value")
    own = F.try_variant_get(v, "$.content_blocks", BLOCKS)
    content = V.text_at(v, "$.content")
    one = F.array(F.struct(*(F.lit("paragraph").alias(n) if n == "type" else content.alias(n) if n == "text" else F.lit(None).cast(t).alias(n) for n, t in BLOCK.items())))
    none = F.array().cast(BLOCKS)
    said = lambda name: F.nullif(strip(V.string_at(v, f"$.{name}")), F.lit(""))
    at = V.string_at(v, "$.published_at")
    zoned = at.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    error = F.when(v.isNull(), "no JSON").when(at.isNotNull() & ~zoned, "time needs a zone")
    return records.select(
        said("external_id").alias("external_id"), said("title").alias("native_title"), said("url").alias("canonical_url"), F.lit("manual").alias("content_kind"), said("author").alias("author_name"), said("language").alias("language"), official.moment(F.when(zoned, at)).alias("published_us"),
        F.coalesce(own, F.when(F.coalesce(content, F.lit("")) != "", one), none).alias("blocks"), F.to_json(F.try_variant_get(v, "$.raw_payload", "variant")).alias("provenance"), F.lit(False).alias("skipped"), error.alias("error"),
    )


@dataclass(frozen=True)
class Connector:
    connector_type: str
    candidates: Callable[[DataFrame], DataFrame]
    options: frozenset[str] = frozenset()


class Registry:
    def __init__(self, *connectors: Connector):
        self._by_type: dict[str, Connector] = {}
        for c in connectors:
            self.register(c)

    def register(self, connector: Connector) -> None:
        if connector.connector_type in self._by_type:
            raise ValueError(f"connector already registered: {connector.connector_type}")
        self._by_type[connector.connector_type] = connector

    def find(self, connector_type: str) -> Connector:
        if connector_type not in self._by_type:
            raise LookupError(f"connector is not registered: {connector_type}")
        return self._by_type[connector_type]

    def types(self) -> list[str]:
        return sorted(self._by_type)


REGISTRY = Registry(
    Connector("baidu_tieba", _tieba), Connector("manual", _manual, frozenset({"title", "url", "content", "content_blocks", "raw_payload", "author", "language", "external_id", "published_at"})), Connector("riot_official", _riot_official),
    Connector("tencent_lol", _tencent_lol, frozenset({"target"})), Connector("weibo", _weibo), Connector("x_twitter", _x_twitter),
)


@dataclass(frozen=True)
class Collected:
    """Candidates (``FIELDS``; those with an error or skipped are not to be taken in),
    the cursor that the fetch began with and a frame of one row with the next one."""

    candidates: DataFrame
    cursor_used: dict
    next_cursor: DataFrame


def judged(candidates: DataFrame) -> DataFrame:
    """Candidates with texts trimmed and what is wrong with each, or null."""
    texts = ("external_id", "native_title", "canonical_url", "author_name", "language")
    trimmed = candidates.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in texts})
    wrong = F.when(F.col("skipped"), F.lit(None)).when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.size("blocks"), F.lit(0)) <= 0, "no content blocks").when(F.col("canonical_url").isNotNull() & ~U.is_http(F.col("canonical_url")), "url must be absolute")
    return trimmed.withColumn("error", wrong).select(*FIELDS)


def advanced_cursor(candidates: DataFrame, cursor: dict, truncated: bool) -> DataFrame:
    """watermark_us, pending_high_us, pending_ids after a fetch: while it is truncated the
    watermark is held and ids, also skipped ones, are remembered; else it moves to the newest time."""
    good = F.col("error").isNull() & ~F.col("skipped")
    newest = F.greatest(F.max(F.when(good, F.col("published_us"))), F.lit(cursor.get("high")).cast("long"))
    held = F.lit(cursor.get("watermark")).cast("long")
    if not truncated:
        none = F.array().cast("array<string>")
        return candidates.agg(F.greatest(newest, held).alias("watermark_us")).select("watermark_us", F.lit(None).cast("long").alias("pending_high_us"), none.alias("pending_ids"))
    before = F.lit([str(x) for x in cursor.get("pending", ())]) if cursor.get("pending") else F.array().cast("array<string>")
    ids = F.collect_set(F.when(good | F.col("skipped"), F.col("external_id")))
    return candidates.agg(newest.alias("pending_high_us"), ids.alias("ids")).select(held.alias("watermark_us"), "pending_high_us", F.array_sort(F.array_union("ids", before)).alias("pending_ids"))


def collect(records: DataFrame, connector_type: str, source_type: str, options: dict | None = None, cursor: dict | None = None, truncated: bool = False, registry: Registry = REGISTRY) -> Collected:
    connector = registry.find(connector_type)
    if source_type != connector.connector_type:
        raise ValueError(f"{connector.connector_type} connector cannot collect {source_type} source")
    if unknown := set(options or {}) - connector.options:
        raise ValueError(f"unsupported {connector.connector_type} run options: {sorted(unknown)}")
    candidates = judged(connector.candidates(records))
    return Collected(candidates, dict(cursor or {}), advanced_cursor(candidates, cursor or {}, truncated))
