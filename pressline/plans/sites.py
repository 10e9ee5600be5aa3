"""Queries over site pages, JSON envelopes and JSON of any shape; with their DuckDB SQL.

The source tables hold no list pages and no envelopes, so Spark writes them from the
rows of ``pages`` and ``documents`` first, and the operators read them back; the SQL
computes what must come out of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import urls as U
from pressline.functions import variants as V
from pressline.sources import official as O


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(x, values):
    return F.element_at(F.array(*(F.lit(v) if not hasattr(v, "_jc") else v for v in values)), (x % len(values) + 1).cast("int"))


# ---- references


def joined_urls(spark, d):
    """Ten forms of reference, each on the pages of one remainder."""
    k = F.col("page_id")
    reference = _pick(k, ("../a/./b?x=1", "?q=1", "#f", "//cdn.example.org/x", "https://o.example.org/y/../z", "/root/../z/", "rel/path", "./", "..", ""))
    return _table(spark, d, "pages").select("page_id", U.join_url(F.col("url"), reference).alias("link"), U.canonical_url(F.col("url")).alias("canonical"))


JOINED_SQL = r"""
with p as (select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '^([a-z]+):', 1) scheme, regexp_extract(url, '^([^?#]*)', 1) bare, regexp_extract(url, '^([^#]*)', 1) whole from pages),
q as (select *, case when path = '' then '/' else regexp_extract(path, '^(.*/)', 1) end folder from p),
r as (select *, case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/$', '') end up from q)
select page_id, case page_id % 10 when 0 then root || up || 'a/b?x=1' when 1 then bare || '?q=1' when 2 then whole || '#f' when 3 then scheme || '://cdn.example.org/x' when 4 then 'https://o.example.org/y/../z' when 5 then root || '/z/'
    when 6 then root || folder || 'rel/path' when 7 then root || folder when 8 then root || up else url end as link,
    scheme || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace(path, '/+$', '') || '/' as canonical
from r
"""

# ---- list pages


def _listings(spark, d):
    """List pages of eight entries: the even ones embed JSON, of the odd ones half hold
    broken JSON, and links with cards."""
    k = F.col("page_id")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    link = _pick(k, (F.concat(F.lit("https://WWW.leagueoflegends.com/en-us/news"), path, F.lit("?x=1#y")), F.concat(F.lit("/en-us/news"), path), F.concat(F.lit("../../en-us/news"), path, F.lit("//")), F.lit("https://other.example.org/en-us/news/a"), F.lit("/en-us/news/")))
    title = F.when(k % 7 == 6, " ").otherwise(F.concat(F.lit("T &amp;\t no. "), (k % 40).cast("string")))
    at = F.concat(F.lit("2024-01-"), F.lpad((k % 40).cast("string"), 2, "0"), _pick(k, ("T10:00:00Z", "T10:00:00.500+08:00", "")))
    category = F.when(k % 3 < 2, F.concat(F.lit(" cat "), (k % 4).cast("string")))
    rows = _table(spark, d, "pages").select(F.floor(k / 8).alias("page_id"), F.col("page_id").alias("k"), link.alias("link"), title.alias("title"), at.alias("at"), category.alias("category"))
    entry = F.struct("k", "link", "title", "at", "category")
    lists = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    item = lambda e: F.struct(e["title"].alias("title"), F.struct(F.struct(e["link"].alias("url")).alias("payload")).alias("action"), e["at"].alias("publishedAt"), F.when(e["category"].isNotNull(), F.struct(e["category"].alias("machineName"))).alias("category"))
    blades = F.array(F.struct(F.lit("hero").alias("type"), F.filter(F.transform("es", item), lambda x: F.lit(False)).alias("items")), F.struct(F.lit("grid").alias("type"), F.transform("es", item).alias("items")))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(blades.alias("blades")).alias("page")).alias("pageProps")).alias("props")))
    card = lambda e: F.concat(F.lit('<div class="card"><a href="'), e["link"], F.lit('"><img src="/i.png"><time datetime="'), e["at"], F.lit('"></time></a><h2>'), e["title"], F.lit("</h2></div>"))
    n = F.col("page_id") % 4
    script = F.when(n == 1, "").otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.when(n == 3, "{broken").otherwise(data), F.lit("</script>")))
    html = F.concat(F.lit("<html><body>"), script, F.when(n % 2 == 1, F.array_join(F.transform("es", card), "")).otherwise(""), F.lit("</body></html>"))
    return lists.select("page_id", html.alias("html"))


def news_list(spark, d):
    return O.list_entries(_listings(spark, d)).drop("ord")


NEWS_LIST_SQL = r"""
with p as (select page_id k, page_id // 8 page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') path from pages),
e as (select *, page_id % 2 = 0 js, case k % 5 when 3 then 'https://other.example.org/en-us/news/a/' when 4 then 'https://www.leagueoflegends.com/en-us/news/' else 'https://www.leagueoflegends.com/en-us/news' || path || '/' end url,
    case when k % 7 <> 6 then 'T & no. ' || k % 40 end title, regexp_extract(path, '^/+([^/]+)', 1) said,
    try_cast(case when k % 3 = 2 then '2024-01-' || lpad((k % 40)::varchar, 2, '0') || ' 00:00:00+00' else '2024-01-' || lpad((k % 40)::varchar, 2, '0') || case k % 3 when 0 then ' 10:00:00+00' else ' 10:00:00.5+08' end end as timestamptz) tm from p),
f as (select * from e where k % 5 < 3 and path <> '' and (title is not null or not js)),
g as (select *, row_number() over (partition by page_id, url order by k) n from f)
select page_id, url, title, epoch_us(tm) published_us, case when js and k % 3 < 2 then 'cat ' || k % 4 else said end category, case when js then 'json' else 'links' end way from g where n = 1 and title is not null
"""

# ---- article pages


def news_articles(spark, d):
    """Articles of the pages: identity, title, and what the blocks hold."""
    a = O.articles(_table(spark, d, "pages"))
    kinds = lambda kind: F.size(F.filter("blocks", lambda b: b["type"] == kind))
    return a.select("page_id", "external_id", "canonical_url", "title", "error", kinds("heading").alias("headings"), kinds("paragraph").alias("paragraphs"))


NEWS_ARTICLES_SQL = r"""
with p as (select page_id, regexp_extract(url, '^([a-z]+://)', 1) || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '/' canonical_url,
    regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) head, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) body from pages),
w as (select *, list_filter(list_transform(regexp_split_to_array(body, '<p(?: [^>]*)?>')[2:], lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<script.*?</script>', '', 'g'), '<[^>]*>', '', 'g'))), lambda x: x <> '') ps from p)
select page_id, sha256(canonical_url) external_id, canonical_url, replace(replace(replace(trim(regexp_replace(regexp_replace(head, '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') title, null::varchar as error,
    len(regexp_extract_all(body, '<h[1-6][ >]')) headings, len(ps) paragraphs from w
"""

# ---- envelopes


def _answers(spark, d):
    """Answers of an article service, written from documents: refused and missing ones,
    redirects of every kind, plain bodies; and the list entry that led to each."""
    k = F.col("doc_id")
    s = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "))
    content = F.concat(F.lit("<p>\x01No. "), s(k), F.lit(" &amp; more</p>"), F.when(k % 9 == 8, "").otherwise(F.concat(F.lit("<div><p>"), words, F.lit("</p></div>"))), F.lit('<img src="/i/a.PNG?x" alt=" A ">'))
    content = F.when(k % 11 == 10, "<p> </p>").otherwise(content)
    redirect = _pick(k, ("", "https://lol.qq.com/act/a20200421weekfree/index.html?siteId=7", "https://lol.qq.com/gicp/news/1/2.html", "https://lol.qq.com/other", "https://away.example.org/x", "ftp://away.example.org/x"))
    hop = F.when(k % 2 == 0, "1").otherwise("0")
    result = F.struct(
        F.concat(F.lit("d"), s(k)).alias("iDocID"), F.when(k % 5 > 0, F.concat(F.lit(" Title\t"), s(k))).alias("sTitle"), F.lit("").alias("sAuthor"), content.alias("sContent"), hop.alias("iIsRedirect"), redirect.alias("sRedirectURL"),
        F.concat(F.lit("2024-02-0"), s(k % 10), F.lit(" 07:30:00")).alias("sCreated"), s(k).alias("iComment"), (k % 3).alias("kept"),
    )
    state = _pick(k, ("1", "1", "1", "1", "0", "1", "1", "1", "2"))
    answer = F.struct(F.parse_json(F.when(k % 2 == 0, state).otherwise(F.concat(F.lit('"'), state, F.lit('"')))).alias("status"), F.when(k % 18 == 4, "News Not Found ").otherwise("bad").alias("msg"), F.struct(F.when(state == "1", result).alias("result")).alias("data"))
    discovery = F.to_json(F.struct(F.concat(F.lit("Found "), s(k)).alias("sTitle"), F.concat(F.lit("By "), s(k % 7)).alias("sAuthor")))
    page = F.concat(F.lit("<html><body><p>menu</p><div class='article big'><h2>Moved "), s(k), F.lit("</h2></div></body></html>"))
    value = F.when(k % 29 == 28, "no json").otherwise(F.to_json(answer))
    return _table(spark, d, "documents").select(k.alias("answer_id"), value.alias("value"), discovery.alias("discovery"), page.alias("html"))


def answer_articles(spark, d):
    a = O.envelope_articles(_answers(spark, d))
    body = F.array_join(F.transform("blocks", lambda b: F.concat_ws("|", b["type"], b["text"], b["source_url"], b["mime_type"], b["alt_text"])), "\n")
    return a.select("answer_id", F.coalesce("docid", F.lit("")).alias("docid"), "title", "author", "canonical_url", "published_us", "redirect", body.alias("body"), "response", "content_length", "missing", "error")


ANSWERS_SQL = r"""
with a as (select doc_id k, doc_id % 29 = 28 broken, case doc_id % 9 when 4 then '0' when 8 then '2' else '1' end state, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) words,
    case doc_id % 6 when 1 then 'https://lol.qq.com/act/a20200421weekfree/index.html?siteId=7' when 2 then 'https://lol.qq.com/gicp/news/1/2.html' when 3 then 'https://lol.qq.com/other' when 4 then 'https://away.example.org/x' when 5 then 'ftp://away.example.org/x' else '' end target from documents),
b as (select *, not broken and state = '1' good, not broken and k % 18 = 4 missing from a),
c as (select *, case when good and k % 2 = 0 and target <> '' then target end redirect, case when good then 'd' || k else '' end docid from b),
d as (select *, case when redirect like 'https://lol.qq.com/act%' then 'w' when redirect like 'https://lol.qq.com/gicp%' then 'n' when redirect like 'https://lol.qq.com/%' then 'u' when redirect like 'https://%' then 'e' end kind,
    case when not good then '' when k % 11 = 10 then '<p> </p>' else '<p>No. ' || k || ' &amp; more</p>' || case when k % 9 = 8 then '' else '<div><p>' || words || '</p></div>' end || '<img src="/i/a.PNG?x" alt=" A ">' end content from c)
select k answer_id, docid, case when good and k % 5 > 0 then 'Title ' || k else 'Found ' || k end title, 'By ' || k % 7 author,
    case when kind is not null then redirect else 'https://lol.qq.com/news/detail.shtml?docid=' || docid end canonical_url,
    case when good and k % 10 > 0 then epoch_us(timestamp '2024-02-01 07:30:00') + (k % 10 - 1) * 86400000000 - 8 * 3600000000 end published_us, redirect,
    case when kind = 'n' then 'heading|Moved ' || k when kind = 'e' then 'embed|查看完整公告|https://away.example.org/x' when kind is not null or not good or k % 11 = 10 then ''
        else 'paragraph|No. ' || k || ' & more' || case when k % 9 = 8 or words = '' then '' else chr(10) || 'paragraph|' || words end || chr(10) || 'image|https://lol.qq.com/i/a.PNG?x|image/png|A' end body,
    case when good then '{"iDocID":"d' || k || '","iIsRedirect":"' || case when k % 2 = 0 then '1' else '0' end || '","kept":' || k % 3 || ',"sAuthor":"","sCreated":"2024-02-0' || k % 10 || ' 07:30:00","sRedirectURL":"' || target || '"' || case when k % 5 > 0 then ',"sTitle":" Title\t' || k || '"' else '' end || '}' end response,
    length(content) content_length, missing,
    case when missing then null when broken then 'no JSON' when not good then 'article failed: ' || case when k % 18 = 4 then 'News Not Found' else 'bad' end when kind = 'u' then 'redirect is not supported' when kind = 'w' then 'weekly page' when kind is null and k % 11 = 10 then 'body is empty' end error
from d
"""

# ---- JSON of any shape


def json_leaves(spark, d):
    """The texts of nested JSON around the properties of events, in the order of their places."""
    kind, n = F.col("event_type"), (F.col("event_id") % 3).cast("string")
    text = F.concat(F.lit('{"z":'), F.coalesce("props", F.lit("{}")), F.lit(',"a":[" '), kind, F.lit(' ",[{"k":"'), F.upper(kind), F.lit('","n":'), n, F.lit(',"o":{}}],false,null,0.0,[]],"m":{"t":"X","u":[[["deep"]]]}}'))
    rows = _table(spark, d, "events").select("event_id", F.try_parse_json(text).alias("v"))
    return V.leaf_texts(rows, "event_id", "v").select("event_id", F.array_join("texts", "|").alias("texts"))


LEAVES_SQL = """
with e as (select event_id, lower(event_type) t, event_id % 3 n, try_cast(json_extract_string(coalesce(props, '{}'), '$.k') as bigint) k from events)
select event_id, t || case when n > 0 then '|' || n else '' end || '|x|deep' || case when k <> 0 and (k <> n or n = 0) then '|' || k else '' end as texts from e
"""

QUERIES = {"joined_urls": joined_urls, "news_list": news_list, "news_articles": news_articles, "answer_articles": answer_articles, "json_leaves": json_leaves}
SQL = {"joined_urls": JOINED_SQL, "news_list": NEWS_LIST_SQL, "news_articles": NEWS_ARTICLES_SQL, "answer_articles": ANSWERS_SQL, "json_leaves": LEAVES_SQL}
