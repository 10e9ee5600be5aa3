"""HTML pages to content blocks: headings, paragraphs, quotes, lists, images and embeds."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.sources.tree import Node, parse

TEXT_TAGS = {"p": "paragraph", "blockquote": "quote", "ul": "list", "ol": "list", **{f"h{i}": "heading" for i in range(1, 7)}}
# Attributes in which pages keep the address of an image, and types by ending.
LAZY = ("src", "data-src", "data-original", "data-lazy-src", "data-echo")
MIMES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif"}

FIELDS = [
    ("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("items", pa.list_(pa.string())), ("ordered", pa.bool_()), ("source_url", pa.string()),
    ("mime_type", pa.string()), ("alt_text", pa.string()), ("caption", pa.string()), ("embed_kind", pa.string()),
]
BLOCK = "type string, text string, level int, items array<string>, ordered boolean, source_url string, mime_type string, alt_text string, caption string, embed_kind string"


def clean(x: str | None) -> str:
    """Character references resolved, NULs dropped, blanks other than line feeds collapsed, trimmed."""
    return re.sub(r"[ \t\r\f\v]+", " ", unescape(x or "").replace("\x00", "")).strip()


def _address(node: Node, names: tuple[str, ...], base: str) -> str | None:
    """The absolute address in the first of the attributes that is set; none for inline data."""
    url = clean(next((node.attributes[n] for n in names if node.attributes.get(n)), None))
    if not url or url.startswith("data:"):
        return None
    try:
        return f"https:{url}" if url.startswith("//") else urljoin(base, url)
    except ValueError:  # no address at all, such as a bracket without its other half
        return None


def _image(node: Node, base: str) -> dict | None:
    url = _address(node, LAZY, base)
    if url is None:
        return None
    path = url.lower().split("?", 1)[0]
    figure = node.parent if node.parent is not None and node.parent.tag == "figure" else None
    caption = figure.first("figcaption") if figure is not None else None
    return {
        "type": "image", "source_url": url, "mime_type": next((m for e, m in MIMES.items() if path.endswith(e)), None), "alt_text": clean(node.attributes.get("alt")) or None,
        "caption": clean(caption.text()) or None if caption is not None else None,
    }


def _embed(node: Node, base: str) -> dict | None:
    url = _address(node, LAZY[:2], base)
    if url is None and not any(node.attributes.get(n) for n in LAZY[:2]):
        source = node.first("source")
        url = _address(source, LAZY[:2], base) if source is not None else None
    return None if url is None else {"type": "embed", "embed_kind": "video" if node.tag == "video" else "iframe", "source_url": url, "caption": clean(node.attributes.get("title")) or None}


def _text(node: Node) -> dict | None:
    kind = TEXT_TAGS[node.tag]
    if kind == "list":
        items = [t for x in node.select("li") if (t := clean(x.text()))]
        return {"type": kind, "items": items, "ordered": node.tag == "ol"} if items else None
    text = clean(node.text())
    if not text:
        return None
    return {"type": kind, "text": text, "level": int(node.tag[1])} if kind == "heading" else {"type": kind, "text": text}


def blocks_below(root: Node, base: str) -> list[dict]:
    """The blocks of an element in document order; a text block takes in those inside it,
    but images and embeds stand for themselves."""
    out, todo = [], [(x, False) for x in reversed(root.children) if not isinstance(x, str)]
    while todo:
        node, inside = todo.pop()
        tag = node.tag
        block = _text(node) if tag in TEXT_TAGS and not inside else _image(node, base) if tag == "img" else _embed(node, base) if tag in ("video", "iframe") else None
        if block is not None:
            out.append(block)
        inside = inside or tag in TEXT_TAGS
        todo += [(x, inside) for x in reversed(node.children) if not isinstance(x, str)]
    return out


def page_blocks(html: str | None, base: str | None, root_selector: str | None = None) -> list[dict]:
    """The blocks of a page, or of the first element that ``root_selector`` finds."""
    root = parse(html)
    if root_selector:
        root = root.first(root_selector)
    return [] if root is None else blocks_below(root, base or "")


def html_blocks(pages: DataFrame, root_selector: str | None = None) -> DataFrame:
    """One row per block of each page (page_id, url, html), in document order."""
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), *FIELDS])

    def run(it):
        for b in it:
            rows = [{"page_id": p, "ord": i, **x} for p, u, h in zip(*(b.column(k).to_pylist() for k in range(3))) for i, x in enumerate(page_blocks(h, u, root_selector))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, f"page_id long, ord int, {BLOCK}")


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of each page."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))).alias("link"))
