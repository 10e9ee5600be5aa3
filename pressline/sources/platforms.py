"""Platform records (JSON text) to canonical records. Records are read as VARIANT, as
platforms name the same thing in several ways; those that cannot be used are kept apart
with a reason, not dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import urls as U
from pressline.functions import variants as V
from pressline.functions.text import clean_text, mime_of, strip

# What is kept of a record as it came, hosts of videos, names of blocks.
TWEET_KEPT = ("id", "id_str", "url", "date", "lang", "rawContent", "conversationId", "hashtags", "links", "media", "isQuoteStatus", "inReplyToTweetId")
WEIBO_KEPT = (
    "mid", "id", "idstr", "mblogid", "bid", "created_at", "text_raw", "text", "isLongText", "continue_tag", "source", "user", "pics", "pic_ids", "page_info", "url_struct",
    "reposts_count", "comments_count", "attitudes_count",
)
REPOST_KEPT = ("mid", "id", "idstr", "mblogid", "bid", "text_raw", "text", "user", "page_info")
VIDEO_HOSTS = ("youtu.be", "youtube.com", "www.youtube.com", "m.youtube.com", "vimeo.com", "www.vimeo.com")
SHORT = r"(?i)https?://t\.co/[A-Za-z0-9]+"
QUOTED, VIDEO, LINKED_VIDEO, LINKED, ATTACHED, MEDIA, PAGE, ORIGINAL = "引用推文", "视频", "外部视频", "外部链接", "附加内容", "媒体内容", "网页链接", "原微博"
PICTURE = "https://wx1.sinaimg.cn/orj960/"

_FIELDS = ("type", "text", "source_url", "mime_type", "alt_text", "embed_kind")


def _block(**fields: Column) -> Column:
    return F.struct(*(fields.get(n, F.lit(None)).cast("string").alias(n) for n in _FIELDS))


def _if(test: Column, block: Column) -> Column:
    """One block, or none."""
    return F.array_compact(F.array(F.when(test, block)))


def _said(v: Column, *paths: str) -> Column:
    """The first of the values at the paths that is not empty, cleaned; else empty."""
    return F.coalesce(*(F.nullif(clean_text(V.text_at(v, p)), F.lit("")) for p in paths), F.lit(""))


def _distinct_by_url(xs: Column) -> Column:
    links = F.transform(xs, lambda x: x["url"])
    return F.filter(xs, lambda x, i: F.array_position(links, x["url"]) == i + 1)


def platform_micros(connector: Column, value: Column) -> Column:
    """Microseconds of a time as each platform writes it: ISO, the mail form, seconds since
    the epoch, or Shanghai's clock; null for anything else, and for zero seconds."""
    mail = F.try_to_timestamp(F.regexp_replace(value, r"^\w+,? ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    seconds = F.when(value.rlike(r"^\s*\d{1,12}\s*$"), F.trim(value).cast("long"))
    clock = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), value)
    shanghai = F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(clock, F.lit("yyyy-M-d H:m:s")), "Asia/Shanghai"))
    return (
        F.when(connector == "weibo", F.unix_micros(mail)).when(connector == "baidu_tieba", F.when(seconds > 0, seconds * 1_000_000)).when(connector == "tencent_lol", shanghai)
        .otherwise(F.unix_micros(F.try_to_timestamp(F.nullif(F.trim(value), F.lit("")))))
    )


# ---- X / Twitter


def known_links(v: Column) -> Column:
    """array<struct<short, url, label>> of the links a tweet (and the one it repeats) names;
    of equal short forms the last counts."""

    def one(x: Column) -> Column:
        url = _said(x, "$.url", "$.expandedUrl", "$.expanded_url")
        host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        label = F.coalesce(F.nullif(_said(x, "$.text", "$.displayUrl", "$.display_url"), F.lit("")), F.nullif(host, F.lit("")), F.lit(LINKED))
        return F.struct(_said(x, "$.tcourl", "$.tcoUrl", "$.tco_url").alias("short"), url.alias("url"), label.alias("label"))

    every = F.filter(F.transform(F.concat(V.items_at(v, "$.links"), V.items_at(v, "$.retweetedTweet.links")), one), lambda x: (x["short"] != "") & (x["url"] != ""))
    shorts = F.transform(F.reverse(every), lambda x: x["short"])
    return F.filter(every, lambda x, i: F.array_position(shorts, x["short"]) == F.size(every) - i)


def _quoted(x: Column) -> Column:
    """Text as a pattern that means itself."""
    return F.concat(F.lit("\\Q"), x, F.lit("\\E"))


def expand_links(text: Column, links: Column) -> Column:
    """Known short links replaced by their labels, or dropped at the end of a line; other
    short links dropped; blanks left behind collapsed."""

    def step(t: Column, x: Column) -> Column:
        label = F.regexp_replace(x["label"], r"([\\$])", r"\\$1")
        return F.replace(F.regexp_replace(t, F.concat(_quoted(x["short"]), F.lit(r"(?=[^\n]*\S)")), label), x["short"], F.lit(""))

    full = F.regexp_replace(F.aggregate(links, text, step), SHORT, "")
    lines = F.transform(F.split(full, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\s+$", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def external_links(text: Column, links: Column, attached: Column) -> Column:
    """Targets of the short links in a text, in order; unknown ones stand for themselves
    where nothing is attached that they could be."""
    shorts = F.regexp_extract_all(text, F.lit(SHORT), F.lit(0))
    target = lambda s: F.coalesce(F.get(F.filter(links, lambda x: x["short"] == s), F.lit(0))["url"], F.when(~attached, s))
    return F.array_distinct(F.array_compact(F.transform(shorts, target)))


def tweets(records: DataFrame, column: str = "value") -> DataFrame:
    """external_id, url, author, lang, published_at, blocks, quoted_id, quoted_url,
    retweeted_id, retweeted_url, response (JSON of the kept fields), rejected, and the
    other columns of ``records``."""
    others = [c for c in records.columns if c != column]
    v = F.col("_v")
    r = records.select(*others, F.try_parse_json(column).alias("_v"))
    r = r.withColumn("_repeats", F.coalesce(V.is_object(F.try_variant_get(v, "$.retweetedTweet", "variant")), F.lit(False))).withColumn("_links", known_links(v))
    said = lambda name: F.when(F.col("_repeats"), _said(v, f"$.retweetedTweet.{name}")).otherwise(_said(v, f"$.{name}"))
    items = lambda name: F.when(F.col("_repeats"), V.items_at(v, f"$.retweetedTweet.{name}")).otherwise(V.items_at(v, f"$.{name}"))
    quoted = F.coalesce(F.nullif(said("quotedTweet.url"), F.lit("")), F.nullif(_said(v, "$.quotedTweet.url"), F.lit("")))
    url = F.coalesce(F.nullif(_said(v, "$.url"), F.lit("")), F.concat(F.lit("https://x.com/"), _said(v, "$.user.username"), F.lit("/status/"), _said(v, "$.id_str", "$.id")))
    photos = F.filter(F.transform(items("media.photos"), lambda p: _block(type=F.lit("image"), source_url=_said(p, "$.url"), mime_type=mime_of(_said(p, "$.url")), alt_text=F.nullif(_said(p, "$.altText", "$.alt_text", "$.alt"), F.lit("")))), lambda b: b["source_url"] != "")
    r = r.withColumns({"_raw": _said(v, "$.rawContent"), "_photos": photos, "_films": F.size(items("media.videos")) > 0, "_quoted": quoted, "_url": url})
    attached = (F.size(items("media.photos")) > 0) | F.col("_films") | F.col("_quoted").isNotNull()
    r = r.withColumns({"_text": expand_links(F.col("_raw"), F.col("_links")), "_out": external_links(F.col("_raw"), F.col("_links"), attached)})
    film = F.coalesce(F.nullif(said("url"), F.lit("")), F.col("_url"))
    seen = lambda x: F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).isin(*VIDEO_HOSTS)
    blocks = F.concat(
        _if(F.col("_text") != "", _block(type=F.lit("paragraph"), text=F.col("_text"))), F.col("_photos"),
        _if(F.col("_quoted").isNotNull(), _block(type=F.lit("embed"), embed_kind=F.lit("quoted_post"), source_url=F.col("_quoted"), text=F.lit(QUOTED))),
        _if(F.col("_films"), _block(type=F.lit("embed"), embed_kind=F.lit("video"), source_url=film, text=F.lit(VIDEO))),
        F.transform("_out", lambda x: _block(type=F.lit("embed"), embed_kind=F.when(seen(x), "video").otherwise("external_link"), source_url=x, text=F.when(seen(x), LINKED_VIDEO).otherwise(LINKED))),
    )
    media = F.try_variant_get(v, "$.media", "variant")
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k.isin(*TWEET_KEPT))
    reduced = F.to_variant_object(F.create_map(F.lit("photos"), V.items_at(v, "$.media.photos")))
    response = F.to_json(F.to_variant_object(F.transform_values(kept, lambda k, x: F.when((k == "media") & V.is_object(media), reduced).otherwise(x))))
    said_or_null = lambda *paths: F.nullif(_said(v, *paths), F.lit(""))
    return r.select(
        *others, said_or_null("$.id_str", "$.id").alias("external_id"), F.col("_url").alias("url"), said_or_null("$.user.displayname").alias("author"), said_or_null("$.lang").alias("lang"), F.try_to_timestamp(V.text_at(v, "$.date")).alias("published_at"),
        blocks.alias("blocks"), said_or_null("$.quotedTweet.id_str", "$.quotedTweet.id").alias("quoted_id"), F.col("_quoted").alias("quoted_url"), said_or_null("$.retweetedTweet.id_str", "$.retweetedTweet.id").alias("retweeted_id"),
        said_or_null("$.retweetedTweet.url").alias("retweeted_url"), response.alias("response"), F.coalesce(v.isNull() | (said_or_null("$.id_str", "$.id").isNull()) | (F.size(blocks) == 0), F.lit(True)).alias("rejected"),
    )


# ---- Weibo


def html_lines(x: Column) -> Column:
    """The texts between tags, a line each, cleaned, without empty ones."""
    lines = F.transform(F.split(F.regexp_replace(x, r"<[^>]*>", "\n"), r"\r\n|[\n\r]"), clean_text)
    return F.array_join(F.filter(lines, lambda v: v != ""), "\n")


def _weibo_kind(object_type: Column) -> Column:
    t = F.lower(object_type)
    return F.when(t.isin("video", "live"), "video").when(t.isin("vote", "poll", "hudongvote"), "poll").otherwise("external_link")


def _attachments(v: Column, url: Column) -> Column:
    """array<struct<label, url, kind>>: what a post has attached, each address once."""
    kind, link = _said(v, "$.page_info.object_type", "$.page_info.type"), _said(v, "$.page_info.page_url")
    label = _said(v, "$.page_info.page_title", "$.page_info.content2")
    label = F.when(label != "", label).otherwise(kind)
    entries = F.filter(F.transform(V.items_at(v, "$.url_struct"), lambda x: F.struct(_said(x, "$.long_url", "$.url_long").alias("url"), _said(x, "$.url_title").alias("title"))), lambda x: U.is_http(x["url"]))
    named = lambda fallback: F.when(label != "", label).otherwise(fallback)
    one = lambda text, to, what: F.struct(text.alias("label"), to.alias("url"), what.alias("kind"))
    page = F.when(U.is_http(link), one(named(ATTACHED), link, _weibo_kind(kind))).when((F.size(entries) == 0) & F.lower(kind).isin("video", "live", "vote", "poll", "hudongvote"), one(named(MEDIA), url, _weibo_kind(kind)))

    def entry(x: Column) -> Column:
        host = F.lower(F.regexp_extract(x["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        all_ = F.lower(F.concat(host, U.part(x["url"], 3), F.lit(" "), x["title"]))
        what = F.when(host.contains("video.weibo.com") | all_.contains("wblive") | x["title"].contains("直播"), "video").when(host.contains("vote.weibo.com") | x["title"].contains("投票"), "poll").otherwise(_weibo_kind(kind))
        return one(F.when(x["title"] != "", x["title"]).otherwise(PAGE), x["url"], what)

    return _distinct_by_url(F.concat(F.array_compact(F.array(page)), F.transform(entries, entry)))


def weibo_posts(records: DataFrame, column: str = "value") -> DataFrame:
    """external_id, url, author, published_at, blocks, quoted_id, quoted_url, response,
    rejected of microblog JSON, and the other columns of ``records``; a repost keeps its
    upstream as a quotation and a link."""
    others = [c for c in records.columns if c != column]
    v = F.col("_v")
    r = records.select(*others, F.try_parse_json(column).alias("_v"))
    up = F.try_variant_get(v, "$.retweeted_status", "variant")
    uid, post = _said(v, "$.user.id", "$.user.idstr"), _said(v, "$.mid", "$.id", "$.idstr")
    bid = _said(v, "$.mblogid", "$.bid")
    url = F.concat(F.lit("https://weibo.com/"), uid, F.lit("/"), F.when(bid != "", bid).otherwise(post))
    shorts = F.filter(F.transform(V.items_at(v, "$.url_struct"), lambda x: _said(x, "$.short_url")), U.is_http)
    text = clean_text(F.aggregate(F.array_distinct(shorts), html_lines(_said(v, "$.text_raw", "$.text")), lambda t, x: F.replace(t, x, F.lit(""))))
    up_author, up_text = _said(up, "$.user.screen_name"), html_lines(_said(up, "$.text_raw", "$.text"))
    up_uid, up_id, up_bid = _said(up, "$.user.id", "$.user.idstr"), _said(up, "$.mid", "$.id", "$.idstr"), _said(up, "$.mblogid", "$.bid")
    up_url = F.when((up_uid != "") & ((up_bid != "") | (up_id != "")), F.concat(F.lit("https://weibo.com/"), up_uid, F.lit("/"), F.when(up_bid != "", up_bid).otherwise(up_id)))
    r = r.withColumns({"_text": text, "_url": url, "_id": post, "_uid": uid, "_up_url": up_url, "_up_text": up_text})
    large = F.filter(F.transform(V.items_at(v, "$.pics"), lambda p: _said(p, "$.large.url", "$.url")), lambda x: x != "")
    named = F.filter(F.transform(V.items_at(v, "$.pic_ids"), lambda p: clean_text(V.text_at(p, "$"))), lambda x: F.coalesce(x != "", F.lit(False)))
    pictures = F.array_distinct(F.concat(large, F.transform(named, lambda p: F.concat(F.lit(PICTURE), p))))
    prefix = F.when(up_author != "", F.concat(F.lit("转发自 @"), up_author, F.lit("："))).otherwise("转发内容：")
    blocks = F.concat(
        _if(F.col("_text") != "", _block(type=F.lit("paragraph"), text=F.col("_text"))), F.transform(pictures, lambda p: _block(type=F.lit("image"), source_url=p, mime_type=mime_of(p))),
        _if(F.coalesce(F.col("_up_text"), F.lit("")) != "", _block(type=F.lit("quote"), text=F.concat(prefix, F.col("_up_text")))),
        _if(F.col("_up_url").isNotNull(), _block(type=F.lit("embed"), embed_kind=F.lit("quoted_post"), text=F.lit(ORIGINAL), source_url=F.col("_up_url"))),
        F.transform(_attachments(v, F.col("_url")), lambda a: _block(type=F.lit("embed"), embed_kind=a["kind"], text=a["label"], source_url=a["url"])),
    )
    kept = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k.isin(*WEIBO_KEPT))
    repost = F.map_filter(F.create_map(F.lit("retweeted_status"), V.only(up, REPOST_KEPT)), lambda k, x: x.isNotNull())
    response = F.to_json(F.to_variant_object(F.map_concat(kept, repost)))
    # the month and week names are fixed English text, so the day of the week is cut off
    at = F.try_to_timestamp(F.regexp_replace(V.text_at(v, "$.created_at"), r"^\w+,? ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    complete = (F.col("_id") != "") & (F.col("_uid") != "") & (F.col("_text") != "")
    return r.select(
        *others, F.nullif("_id", F.lit("")).alias("external_id"), F.col("_url").alias("url"), F.nullif(_said(v, "$.user.screen_name"), F.lit("")).alias("author"), at.alias("published_at"), blocks.alias("blocks"),
        F.nullif(up_id, F.lit("")).alias("quoted_id"), F.col("_up_url").alias("quoted_url"), response.alias("response"), (~F.coalesce(complete, F.lit(False))).alias("rejected"),
    )


def thread_floors(posts: DataFrame, role: str = "user") -> DataFrame:
    """conv_id, blocks: the author's posts of a thread in order, a heading and a paragraph
    for each floor that says something."""
    own = posts.where((F.col("role") == role) & (F.length(F.trim("text")) > 0))
    one = lambda kind, text, level: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(level).cast("int").alias("level"))
    floor = F.array(one("heading", F.concat(F.lit("Floor "), F.col("turn").cast("string")), 3), one("paragraph", F.trim("text"), None))
    return own.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", floor.alias("floor")))), lambda x: x["floor"])).alias("blocks"))


def thread_text(posts: DataFrame, role: str = "user") -> DataFrame:
    """conv_id, n_posts, text: the author's posts of a thread as one document, a heading
    per floor. The posts of a thread meet in one group; a thread is one document."""
    own = posts.where((F.col("role") == role) & (F.length(F.trim("text")) > 0))
    part = F.concat(F.lit("Floor "), F.col("turn").cast("string"), F.lit("\n\n"), F.trim("text"))
    return own.groupBy("conv_id").agg(F.count("*").alias("n_posts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))
