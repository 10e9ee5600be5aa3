"""News sites: list pages, article pages and JSON envelopes of articles.

JSON of unknown shape is read as VARIANT, pages as trees; both judge each record by
itself, so nothing is shuffled. A record that cannot be used keeps its row and says why."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import urls as U
from pressline.functions import variants as V
from pressline.functions.text import clean_text
from pressline.sources.html_blocks import BLOCK, FIELDS, blocks_below, clean, page_blocks
from pressline.sources.tree import Node, parse

# ---- list pages

# The site, and where its pages keep the list as JSON.
LIST_URL, SITE, SECTION = "https://www.leagueoflegends.com/en-us/news/", "www.leagueoflegends.com", "/en-us/news"
EMBEDDED = r"""(?is)<script\b[^>]*\bid\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script\s*>"""
CARD_TITLE = '[data-testid="card-title"]'
ENTRY = "struct<url:string,title:string,published_at:string,category:string>"


def _category(url: Column) -> Column:
    """The path segment after the first one named news."""
    found = F.regexp_extract(U.part(url, 3), r"^(?:/+(?!news(?:/|$))[^/]+)*/+news/+([^/]+)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def _entry(url: Column, title: Column, published: Column, category: Column) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), published.alias("published_at"), category.alias("category"))


def _firsts(xs: Column) -> Column:
    """Of entries with the same URL the first."""
    links = F.transform(xs, lambda x: x["url"])
    return F.filter(xs, lambda x, i: F.array_position(links, x["url"]) == i + 1)


def embedded_entries(html: Column, list_url: str, site: str, section: str) -> Column:
    """The entries of the list that a page embeds as JSON; empty where it has none."""
    data = F.try_parse_json(F.nullif(F.regexp_extract(html, EMBEDDED, 1), F.lit("")))
    blades = V.items_at(data, "$.props.pageProps.page.blades")
    items = F.flatten(F.transform(blades, lambda b: V.items_at(b, "$.items")))

    def one(v: Column) -> Column:
        url = U.canonical_url(U.join_url(F.lit(list_url), V.string_at(v, "$.action.payload.url")))
        category = F.try_variant_get(v, "$.category", "variant")
        named = F.coalesce(clean_text(V.text_at(v, "$.category.machineName")), F.lit(""))
        return _entry(url, clean_text(V.text_at(v, "$.title")), V.text_at(v, "$.publishedAt"), F.when(V.is_object(category), named).otherwise(_category(url)))

    def wanted(x: Column) -> Column:
        path = U.part(x["url"], 3)
        return (U.part(x["url"], 2) == site) & path.startswith(section + "/") & (path != section + "/") & (x["title"] != "")

    return _firsts(F.filter(F.transform(items, one), wanted))


def _cards(html: str) -> list[dict]:
    """Links to news with the title and time of the card around them, in order."""
    out = []
    for anchor in parse(html).select('a[href*="/news/"]'):
        card = anchor.parent
        for _ in range(4):
            if card is None or card.first("time") is not None or card.first(CARD_TITLE) is not None:
                break
            card = card.parent
        scope = card if card is not None else anchor
        title, time = scope.first(f"{CARD_TITLE},h2,h3"), scope.first("time")
        both = title is not None and time is not None
        out.append({"url": anchor.attributes.get("href"), "title": clean(title.text()) if both else None, "published_at": time.attributes.get("datetime") if both else None, "category": None})
    return out


def list_entries(pages: DataFrame, list_url: str = LIST_URL, site: str = SITE, section: str = SECTION) -> DataFrame:
    """page_id, ord, url, title, published_us, category, way of each entry of a list page
    (page_id, html): from the JSON it embeds, or where that gives none from its links.
    Each canonical URL counts once, where it stands first; pages are read once."""
    entry = pa.struct([(n, pa.string()) for n in ("url", "title", "published_at", "category")])
    schema = pa.schema([("page_id", pa.int64()), ("embedded", pa.list_(entry)), ("cards", pa.list_(entry))])

    def run(it):
        for b in it:
            cards = [_cards(h) if h else [] for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), pa.array(cards, schema.field(2).type)], schema=schema)

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", embedded_entries(F.col("html"), list_url, site, section).alias("embedded"))
    # only pages without a list of their own are made a tree
    both = read.select("page_id", "embedded", F.when(F.coalesce(F.size("embedded"), F.lit(0)) == 0, F.col("html")).alias("html")).mapInArrow(run, f"page_id long, embedded array<{ENTRY}>, cards array<{ENTRY}>")
    links = F.transform("cards", lambda c: _entry(U.canonical_url(U.join_url(F.lit(list_url), c["url"])), c["title"], c["published_at"], F.lit("")))
    own = F.filter(_firsts(F.filter(links, lambda c: (U.part(c["url"], 2) == site) & (c["url"] != list_url))), lambda c: F.coalesce(c["title"], F.lit("")) != "")
    linked = F.transform(own, lambda c: _entry(c["url"], c["title"], c["published_at"], _category(c["url"])))
    embedded = F.coalesce(F.size("embedded"), F.lit(0)) > 0
    rows = both.select("page_id", F.when(embedded, "json").otherwise("links").alias("way"), F.posexplode(F.when(embedded, F.col("embedded")).otherwise(linked)).alias("ord", "e"))
    return rows.select("page_id", "ord", "e.url", "e.title", moment(F.col("e.published_at")).alias("published_us"), "e.category", "way")


def moment(text: Column) -> Column:
    """Microseconds of an ISO time; a time without zone is UTC; null for anything else."""
    return F.unix_micros(F.try_to_timestamp(F.nullif(clean_text(text), F.lit(""))))


# ---- article pages

RICH_TEXT = '[data-testid="ArticleRichTextBlade"] [data-testid="rich-text-html"],[data-testid="RichTextPatchNotesBlade"] [data-testid="rich-text-html"]'
BODIES = ('[data-testid="ArticleRichTextBlade"]', "article", "main", "body")


def _says(blocks: list[dict]) -> bool:
    return any(b.get("text") or b.get("items") for b in blocks)


def _article(html: str | None, url: str | None) -> dict:
    tree = parse(html)
    title, time = tree.first('[data-testid="title"],h1'), tree.first("time")
    authors = [t for n in tree.select('[data-testid="author-name"],.author-name') if (t := clean(n.text()))]
    roots: list[Node] = tree.select(RICH_TEXT)
    blocks = [b for r in roots for b in blocks_below(r, url or "")]
    for selector in BODIES:
        if _says(blocks):
            break
        root = tree.first(selector)
        blocks = blocks_below(root, url or "") if root is not None else []
    return {"title": clean(title.text()) if title is not None else "", "time": time.attributes.get("datetime") if time is not None else None, "author": ", ".join(authors) or None, "blocks": blocks}


ARTICLE = f"title string, time string, author string, blocks array<struct<{', '.join(f.replace(' ', ':', 1) for f in BLOCK.split(', '))}>>"


def articles(pages: DataFrame) -> DataFrame:
    """page_id, external_id, canonical_url, title, author, published_us, blocks, error of
    article pages (page_id, url, html): the title and time of the page, the rich-text parts
    or else the body; the id is the hash of the canonical URL."""
    block = pa.struct(FIELDS)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("time", pa.string()), ("author", pa.string()), ("blocks", pa.list_(block))])

    def run(it):
        for b in it:
            ids, links, htmls = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_pylist([{"page_id": p, "url": u, **_article(h, u)} for p, u, h in zip(ids, links, htmls)], schema=schema)

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, url string, {ARTICLE}")
    says = F.exists("blocks", lambda b: (F.coalesce(b["text"], F.lit("")) != "") | (F.coalesce(F.size(b["items"]), F.lit(0)) > 0))
    canonical = U.canonical_url(F.col("url"))
    return read.select("page_id", F.sha2(canonical, 256).alias("external_id"), canonical.alias("canonical_url"), F.nullif("title", F.lit("")).alias("title"), "author", moment(F.col("time")).alias("published_us"), "blocks", F.when(~says, "body is empty").alias("error"))


# ---- JSON envelopes

# The site that redirects may stay on, its address of an article, and the
# fields of an answer that are no part of what is kept of it.
TRUSTED = r"^https://lol\.qq\.com(?::\d+)?(?:[/?#]|$)"
ARTICLE_URL = "https://lol.qq.com/news/detail.shtml?docid="
WEEK_FREE, NEWS_PAGE = "/act/a20200421weekfree/index.html", r"^/gicp/news/.*\.html$"
DROPPED = ("sContent", "iComment", "iShareNum", "iLikeNum", "likeTotal")


def strip_controls(x: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def shanghai_micros(text: Column) -> Column:
    """Microseconds of a time of the form 2024-01-31 08:00:00 on Shanghai's clock."""
    good = F.when(clean_text(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), clean_text(text))
    return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(good, F.lit("yyyy-M-d H:m:s")), "Asia/Shanghai"))


def _said(*values: Column) -> Column:
    """The first value that is not empty, cleaned; else empty."""
    return F.coalesce(*(F.nullif(clean_text(v), F.lit("")) for v in values), F.lit(""))


def _failure(data: Column) -> Column:
    return F.coalesce(F.nullif(clean_text(V.text_at(data, "$.msg")), F.lit("")), F.lit("unknown error"))


def envelope_list(answers: DataFrame) -> DataFrame:
    """answer_id, ord, docid, title, published_us, redirect, entry (VARIANT), error of list
    answers (answer_id, value): one row for each entry that has an id; a refused answer is
    one row with its error."""
    data = F.try_parse_json("value")
    status = V.text_at(data, "$.status")
    error = F.when(data.isNull(), "no JSON").when(status.isNotNull() & (status != "1"), F.concat(F.lit("list failed: "), _failure(data)))
    entries = F.filter(V.items_at(data, "$.data.result"), lambda v: V.is_object(v) & ~F.coalesce(V.text_at(v, "$.iDocID"), F.lit("")).isin("", "0", "false"))
    rows = answers.select("answer_id", error.alias("error"), entries.alias("entries"))
    good = rows.where("error is null").select("answer_id", F.posexplode("entries").alias("ord", "entry"))
    at = lambda name: V.text_at(F.col("entry"), f"$.{name}")
    listed = good.select("answer_id", "ord", clean_text(at("iDocID")).alias("docid"), clean_text(at("sTitle")).alias("title"), shanghai_micros(at("sCreated")).alias("published_us"), F.when(at("iIsRedirect") == "1", clean_text(at("sRedirectURL"))).alias("redirect"), "entry", F.lit(None).cast("string").alias("error"))
    refused = rows.where("error is not null").select("answer_id", *(F.lit(None).cast(t).alias(n) for n, t in (("ord", "int"), ("docid", "string"), ("title", "string"), ("published_us", "long"), ("redirect", "string"), ("entry", "variant"))), "error")
    return listed.unionByName(refused)


def redirect_kind(url: Column) -> Column:
    """Where a redirect leads: weekly_free, news_page, unsupported (on the trusted site),
    external, or null for no web address."""
    path = F.lower(U.part(url, 3))
    own = F.when(path == WEEK_FREE, "weekly_free").when(path.rlike(NEWS_PAGE), "news_page").otherwise("unsupported")
    return F.when(F.lower(url).rlike(TRUSTED), own).when(U.is_http(url), "external")


def envelope_articles(answers: DataFrame) -> DataFrame:
    """answer_id, docid, title, author, canonical_url, published_us, redirect, blocks,
    response (what is kept of the answer, as JSON), missing, error of article answers
    (answer_id, value, discovery: the list entry as JSON, html: the page that a trusted
    redirect led to, or null).

    A missing article is no error: its id is to be skipped. The body is the answer's own
    html without control characters, the page of a trusted redirect, or a link to an
    external one; weekly pages are looked up (``lookup_list``), not parsed."""
    data, found = F.try_parse_json("value"), F.try_parse_json(F.coalesce("discovery", F.lit("{}")))
    rows = answers.select("answer_id", F.col("html").alias("page"), data.alias("data"), found.alias("found"), F.try_variant_get(data, "$.data.result", "variant").alias("result"))
    status = V.text_at(F.col("data"), "$.status")
    at = lambda name: _said(V.text_at(F.col("result"), f"$.{name}"), V.text_at(F.col("found"), f"$.{name}"))
    missing = (status == "0") & (F.lower(_failure(F.col("data"))) == "news not found")
    refused = F.when(F.col("data").isNull(), "no JSON").when(~F.coalesce(status == "1", F.lit(False)) | ~V.is_object(F.col("result")), F.concat(F.lit("article failed: "), _failure(F.col("data"))))
    redirect = F.when(at("iIsRedirect") == "1", F.nullif(at("sRedirectURL"), F.lit("")))
    cut = rows.select(
        "answer_id", "page", "result", F.coalesce(missing, F.lit(False)).alias("missing"), refused.alias("refused"), at("iDocID").alias("docid"), F.nullif(at("sTitle"), F.lit("")).alias("title"), F.nullif(at("sAuthor"), F.lit("")).alias("author"),
        shanghai_micros(at("sCreated")).alias("published_us"), redirect.alias("redirect"), strip_controls(F.coalesce(V.text_at(F.col("result"), "$.sContent"), F.lit(""))).alias("content"),
    ).withColumn("kind", redirect_kind(F.col("redirect")))
    url = F.when(F.col("kind").isNotNull(), F.col("redirect")).otherwise(F.concat(F.lit(ARTICLE_URL), F.col("docid")))
    body = F.when(F.col("kind") == "news_page", F.col("page")).when(F.col("kind").isNull(), F.col("content"))
    ready = cut.withColumn("canonical_url", url).withColumn("body", body)
    names = ["answer_id", "docid", "title", "author", "canonical_url", "published_us", "redirect", "kind", "missing", "refused"]
    kept = F.to_json(V.without(F.col("result"), DROPPED))
    held = ready.select(*names, kept.alias("response"), F.length("content").alias("content_length"), "body")
    block = pa.struct(FIELDS)

    def run(it):
        for b in it:
            at = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("body", "canonical_url", "kind")}
            blocks = []
            for html, base, kind in zip(at["body"], at["canonical_url"], at["kind"]):
                of = page_blocks(html, base) if html and kind is None else []
                for selector in (".article", "article", "main") if html and kind else ():
                    if _says(of := page_blocks(html, base, selector)):
                        break
                blocks.append(of if kind != "external" else [{"type": "embed", "embed_kind": "external_link", "source_url": base, "text": "查看完整公告"}])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blocks, pa.list_(block))], names=[*b.schema.names[:-1], "blocks"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    parsed = held.mapInArrow(run, f"{fields}, {ARTICLE.split(', ', 3)[3]}")
    says = (F.col("kind") == "external") | F.exists("blocks", lambda b: (F.coalesce(b["text"], F.lit("")) != "") | (F.coalesce(F.size(b["items"]), F.lit(0)) > 0))
    error = F.when(F.col("missing"), F.lit(None)).when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("kind") == "unsupported", "redirect is not supported").when(F.col("kind") == "weekly_free", "weekly page").when(~F.coalesce(says, F.lit(False)), "body is empty")
    return parsed.select(*names[:7], "blocks", "response", "content_length", "missing", error.alias("error"))
