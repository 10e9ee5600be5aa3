"""Content blocks: arrays of tagged structs, checked and rewritten by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.text import strip

BLOCK = "struct<id:string,type:string,text:string,level:int,items:array<string>,ordered:boolean,author:string,source_url:string,storage_path:string,alt_text:string,caption:string,mime_type:string,embed_kind:string>"
FIELDS = "id type text level items ordered author source_url storage_path alt_text caption mime_type embed_kind".split()
TEXT_TYPES = ("heading", "paragraph", "quote", "list")
TYPES = (*TEXT_TYPES, "image", "embed")


def _trimmed(b: Column) -> Column:
    """A raw block with its type, text and items trimmed once."""
    return F.struct(
        F.lower(strip(F.coalesce(b["type"], F.lit("")))).alias("raw"), strip(b["text"]).alias("text"),
        F.filter(F.transform(b["items"], strip), lambda x: x != "").alias("items"), b.alias("b"),
    )


def checked_blocks(blocks: Column) -> Column:
    """For each raw block: error (what is wrong with it, or null) and block (its canonical
    form: numbered id, folded type, trimmed text, defaults). A document with an error is
    to be rejected."""

    def one(t, i):
        b, raw, text, number = t["b"], t["raw"], t["text"], (i + 1).cast("string")
        kind = F.when(raw == "video", "embed").otherwise(raw)
        plain = raw.isin("heading", "paragraph", "quote")
        empty = F.coalesce(text == "", F.lit(True))
        error = (
            F.when(~kind.isin(*TYPES), "unsupported type")
            .when(plain & empty, "text required")
            .when((raw == "list") & (F.coalesce(F.size(t["items"]), F.lit(0)) <= 0) & (b["items"].isNotNull() | empty), "item required")
            .when((raw == "image") & b["source_url"].isNull() & b["storage_path"].isNull(), "source required")
            .when((kind == "embed") & ~F.coalesce(b["source_url"].rlike(r"^https?://[^/]"), F.lit(False)), "url required")
        )
        block = F.struct(
            F.concat(F.lit("b"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("id"), kind.alias("type"), F.when(plain, text).alias("text"),
            F.when(raw == "heading", F.least(F.greatest(F.coalesce(b["level"], F.lit(2)), F.lit(1)), F.lit(6))).alias("level"),
            F.when(raw == "list", F.coalesce(t["items"], F.array(text))).alias("items"), F.when(raw == "list", F.coalesce(b["ordered"], F.lit(False))).alias("ordered"),
            *(b[c].alias(c) for c in ("author", "source_url", "storage_path", "alt_text", "caption", "mime_type")),
            F.when(raw == "video", F.coalesce(b["embed_kind"], F.lit("video"))).when(raw == "embed", b["embed_kind"]).alias("embed_kind"),
        )
        return F.struct(error.alias("error"), block.alias("block"))

    return F.transform(F.transform(blocks, _trimmed), one)


def first_error(checked: Column) -> Column:
    """The first error of ``checked_blocks``, or null."""
    return F.get(F.filter(checked, lambda c: c["error"].isNotNull()), F.lit(0))["error"]


def normalize_blocks(blocks: Column) -> Column:
    """The canonical blocks alone."""
    return F.transform(checked_blocks(blocks), lambda c: c["block"])


def block_text(blocks: Column) -> Column:
    """Text of the text blocks: list items by line, blocks by empty line."""
    parts = F.transform(blocks, lambda b: F.when(b["type"] == "list", F.array_join(F.filter(b["items"], lambda x: strip(x) != ""), "\n")).when(b["type"].isin("heading", "paragraph", "quote"), strip(b["text"])))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), "\n\n")


def has_quoted_post(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: (b["type"] == "embed") & F.coalesce(b["embed_kind"] == "quoted_post", F.lit(False)))


def _lines(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?m)[ \t\r\f\x0B]+$", ""))


def content_hash(blocks: Column) -> Column:
    """sha256 of the blocks' meaning: fields by name, without local copies and types of
    media, line ends stripped, nulls left out."""
    order = sorted(set(FIELDS) - {"storage_path", "mime_type"})
    volatile = r"^(https?://)(?i:tiebapic\.baidu\.com)([^?#]*).*$"

    def one(b):
        def field(name):
            if name in ("text", "author", "alt_text", "caption"):
                return _lines(b[name])
            if name == "items":
                return F.transform(b["items"], _lines)
            if name == "source_url":
                return F.regexp_replace(b[name], volatile, "$1tiebapic.baidu.com$2")
            return b[name]

        return F.struct(*(field(n).alias(n) for n in order))

    return F.sha2(F.to_json(F.transform(blocks, one)), 256)
