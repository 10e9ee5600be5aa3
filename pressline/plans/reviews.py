"""Queries over corrections, labels, children, alerts and small rules; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import blocks as B
from pressline.functions import packing
from pressline.functions import text as T
from pressline.functions import vocab as V
from pressline.operators import daily, ops, reviews, search
from pressline.plans.detail import _assets, _pick
from pressline.plans.messages import CLASSIFY, E
from pressline.plans.sql_events import q
from pressline.sources import connectors
from pressline.sources.adapter import view


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- corrections


def review_corrections(spark, d):
    """Reviews of items, with labels broken as in ``classification_errors`` and corrections of every kind."""
    i, k = view(spark, d, "item"), F.col("id")
    products = F.when(k % 31 == 0, F.array(F.lit("unknown"), F.col("product"))).when(k % 37 == 0, F.array("product", "product")).otherwise(F.col("products"))
    topics = F.when(k % 41 == 0, F.array(F.col("topic"), F.lit("unknown"))).when(k % 43 == 0, F.array(F.lit("champions"))).otherwise(F.array("topic"))
    null = F.lit(None)
    rows = i.select(
        "id", _pick(k, ("importance", "importance", "relevance", "message_analysis")).alias("stage"), F.lit("process").alias("decision"), "products", "content_form", F.lit("unknown").alias("message_type"), F.array(F.lit("unknown")).alias("topics"), "importance_score", (F.col("importance_score") / 2).alias("computed_score"),
        F.when(k % 13 > 0, "title").alias("title"), F.when(k % 17 > 0, "summary").otherwise(" ").alias("summary"), (k % 2).alias("n_entities"), F.when(k % 10 == 2, "skip").alias("new_decision"), F.when(k % 4 == 3, products).alias("new_products"),
        null.cast("string").alias("new_content_form"), F.when(k % 4 == 0, F.col("message_type")).alias("new_message_type"), F.when(k % 4 == 0, topics).alias("new_topics"), F.when(k % 6 == 1, F.lit(0.25)).alias("new_importance_score"),
        F.when(k % 19 > 0, products).alias("analysis_products"), F.col("content_form").alias("analysis_form"), _pick(k, ("official", "unofficial", "unknown")).alias("source_kind"),
    )
    c = reviews.corrected_proposals(rows)
    return c.select("id", F.coalesce("error", F.lit("")).alias("error"), "final_decision", F.array_join("final_products", ",").alias("final_products"), "final_message_type", F.round("final_score", 6).alias("final_score"), "override", F.round("kept_score", 6).alias("kept_score"))


CORRECTIONS_SQL = q(
    CLASSIFY
    + f""",
    r as (select i.*, c.pr, cls.error label_error, i.id % 4 st, case when i.id % 4 = 3 then c.pr else i.products end fp, i.id % 4 = 0 labelled, i.id % 6 = 1 scored,
        array_to_string(list_sort(list_filter([case when i.id % 10 = 2 and i.id % 4 <> 2 then 'decision' end, case when i.id % 6 = 1 and i.id % 4 > 1 then 'importance_score' end], lambda x: x is not null)), ', ') odd
        from item i join c1 c using (id) join cls using (id)),
    a as (select *, case when content_form in ('media_only', 'link_only') then (case when id % 17 > 0 or id % 2 > 0 then {E['bare_content']} end) when id % 13 = 0 then {E['title']} when id % 17 = 0 then {E['summary']} end said,
        case when len(fp) > 3 or len(list_distinct(fp)) < len(fp) then {E['product_count']} when list_filter([{', '.join(repr(p) for p in V.PRODUCTS)}], lambda x: list_contains(fp, x)) <> fp then {E['product_order']}
            when list_contains(fp, 'unknown') and len(fp) > 1 then {E['product_unknown']} when content_form in ('media_only', 'link_only') and fp <> ['unknown'] then {E['form_products']} end form_error from r),
    e as (select *, case when odd <> '' then 'unsupported: ' || odd when st = 3 then coalesce(form_error, said) when labelled and id % 19 = 0 then 'no approved analysis' when labelled then nullif(label_error, '') end err from a)""",
    """select id, coalesce(err, '') error, case when err is null then (case when id % 10 = 2 then 'skip' else 'process' end) end final_decision, case when err is null then array_to_string(fp, ',') else '' end final_products,
    case when err is null then (case when labelled then message_type else 'unknown' end) end final_message_type, case when err is null then (case when scored then 0.25::double else round(importance_score, 6) end) end final_score,
    err is null and st < 2 and scored override, case when err is null and st < 2 and scored then round(importance_score / 2, 6) end kept_score from e""",
).replace("else '' end final_products", "end final_products")

# ---- labels


def legal_label_sets(spark, d):
    """What the catalogue allows for the products and sides that messages have."""
    i = view(spark, d, "item").select("products", _pick(F.col("id"), V.SOURCE_KINDS).alias("source_kind")).distinct()
    legal = reviews.legal_labels(F.col("products"), F.col("source_kind"))
    return i.select(F.array_join("products", ",").alias("named"), "source_kind", legal.alias("l")).select(F.col("named").alias("products"), "source_kind", F.array_join("l.types", ",").alias("types"), F.array_join("l.topics", ",").alias("topics"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_types = ", ".join(f"('{t}', {_list(ps)}, '{s}', {i})" for i, (t, ps, s) in enumerate(V.MESSAGE_TYPES))
_topics = ", ".join(f"('{t}', {_list(ps)}, {i})" for i, (t, ps, _) in enumerate(V.TOPICS))
LEGAL_SQL = q(
    f"""mt as (select * from (values {_types}) v(code, ps, side, ord)), tp as (select * from (values {_topics}) v(code, ps, ord)),
    d as (select distinct products, ({_list(V.SOURCE_KINDS)})[id % 3 + 1] source_kind from item)""",
    """select array_to_string(products, ',') products, source_kind, (select string_agg(code, ',' order by ord) from mt where code = 'unknown' or (list_has_any(ps, d.products) and (source_kind = 'unknown' or side in ('any', source_kind)))) types,
    (select string_agg(code, ',' order by ord) from tp where code = 'unknown' or list_has_any(ps, d.products)) topics from d""",
)


def ordered_topics(spark, d):
    """Two or three topics of each message in the catalogue's order, unknown words dropped."""
    k, n = F.col("id"), len(V.TOPIC_ORDER)
    topics = F.array(_pick(k * 7, V.TOPIC_ORDER), _pick(k, V.TOPIC_ORDER), F.lit("no such topic"), _pick(k * 3, V.TOPIC_ORDER))
    return view(spark, d, "raw").select("id", F.array_join(reviews.ordered_topics(topics), ",").alias("topics")).where(F.lit(n > 0))


TOPICS_SQL = q(
    f"o as (select unnest({_list(V.TOPIC_ORDER)}) t, unnest(range({len(V.TOPIC_ORDER)})) n), s as (select id, unnest([id * 7 % {len(V.TOPIC_ORDER)}, id % {len(V.TOPIC_ORDER)}, id * 3 % {len(V.TOPIC_ORDER)}]) n from raw)",
    "select id, string_agg(distinct t, ',' order by n) topics from (select distinct id, n from s) join o using (n) group by id".replace("string_agg(distinct t", "string_agg(t"),
)


def claim_fingerprints(spark, d):
    """The hash of each mention's claim, and the label that its entity shows first."""
    m = view(spark, d, "mention_all")
    shown = reviews.first_text(F.when(F.col("id") % 3 == 0, F.col("fingerprint")), F.when(F.col("id") % 2 == 0, F.lit("  ")), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" "), F.col("relation"), F.lit("\t"))))
    return m.select("id", reviews.claim_fingerprint(F.col("relation"), F.when(F.col("id") % 4 > 0, F.col("materiality")), F.col("fingerprint")).alias("claim"), shown.alias("shown"))


CLAIMS_SQL = q(
    "z as (select 1)",
    """select id, sha256('{"excerpt":' || coalesce(to_json(fingerprint)::varchar, 'null') || ',"family":"' || relation || '","product":' || case when id % 4 > 0 then '"' || materiality || '"' else 'null' end || '}') claim,
    coalesce(nullif(trim(case when id % 3 = 0 then fingerprint end), ''), case when id % 5 > 0 then relation end, '') shown from mention_all""",
)


def messages_without_type(spark, d):
    """How many messages each choice of the type filter finds, the word null among them."""
    i = view(spark, d, "item").select(F.when(F.col("id") % 8 > 0, F.col("message_type")).alias("message_type"))
    one = lambda w: i.where(reviews.has_type(F.col("message_type"), w)).agg(F.lit(w).alias("wanted"), F.count("*").alias("n"))
    return one("null").unionByName(one("game_leak")).unionByName(one("unknown"))


TYPES_SQL = q("i as (select case when id % 8 > 0 then message_type end t from item)", "select 'null' wanted, count(*) filter (t is null) n from i union all select 'game_leak', count(*) filter (t = 'game_leak') from i union all select 'unknown', count(*) filter (t = 'unknown') from i")


# ---- sources of reposts


def repost_accounts(spark, d):
    """The side of messages whose upstream names an account of a platform, or a site."""
    k = F.col("page_id")
    account = F.concat(_pick(k, ("https://www.X.com/", "https://twitter.com/", "https://weibo.com/u/", "https://weibo.com/")), F.lit("User"), (k % 40).cast("string"), F.lit("/status/1"))
    pages = _table(spark, d, "pages").select(k.alias("p"), F.when(k % 5 == 4, F.col("url")).otherwise(account).alias("upstream"))
    items = view(spark, d, "item").select("id", F.when(F.col("id") % 9 > 0, "repost").otherwise(F.col("content_form")).alias("content_form"), (F.col("id") % 6).isin(0, 3).alias("is_official"), F.col("id").alias("p"))
    sources = view(spark, d, "src")
    accounts = sources.select(F.col("connector_type"), F.concat(F.lit("uSER"), F.col("id") % 15).alias("external_key"), "is_official")
    sites = spark.createDataFrame([("example.com", True), ("example.org", False)], "site string, official boolean")
    return ops.classification_source(items.join(pages, "p", "left"), sites, accounts.withColumnRenamed("is_official", "official"))


_host = r"regexp_replace(lower(regexp_extract(upstream, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
ACCOUNTS_SQL = q(
    rf"""p as (select page_id, case when page_id % 5 = 4 then url else (['https://www.X.com/', 'https://twitter.com/', 'https://weibo.com/u/', 'https://weibo.com/'])[page_id % 4 + 1] || 'User' || page_id % 40 || '/status/1' end upstream, case when page_id % 5 < 4 then case when page_id % 4 < 2 then 'x_twitter' else 'weibo' end end platform, 'user' || page_id % 40 ext from pages),
    i as (select id, case when id % 9 > 0 then 'repost' else content_form end form, id % 6 in (0, 3) own, p.* from item left join p on page_id = id),
    acc as (select connector_type, 'user' || id % 15 ext, is_official from src),
    ma as (select i.id, count(*) n, bool_or(is_official) up from i join acc on acc.connector_type = i.platform and acc.ext = i.ext group by 1),
    ms as (select id, count(*) n, bool_or(o) up from (select id, {_host} h from i where platform is null) join (values ('example.com', true), ('example.org', false)) v(site, o) on h = site or h like '%.' || site group by 1),
    m as (select * from ma union all select * from ms)""",
    "select i.id, case when form <> 'repost' then (case when own then 'official' else 'unofficial' end) when n = 1 then (case when up then 'official' else 'unofficial' end) else 'unknown' end source_kind, case when form <> 'repost' then 'current' when n = 1 then 'upstream' else 'unresolved' end basis from i left join m on m.id = i.id",
)

# ---- children and alerts


def message_children(spark, d):
    """Messages with their source, media and links in order."""
    assets = _assets(spark, d).withColumn("mime_type", T.mime_of(F.concat(F.col("public_path"), _pick(F.col("asset_id"), (".PNG", ".jpeg?x", ".bin")))))
    links = _table(spark, d, "pages").select((F.col("page_id") % 70).alias("item_id"), F.floor(F.col("page_id") / 70).cast("int").alias("position"), "url", F.concat(F.lit("l"), F.col("page_id").cast("string")).alias("label"))
    c = reviews.with_children(view(spark, d, "item").select("id", "source_id"), view(spark, d, "src"), assets, links)
    show = lambda xs, *fs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fs))), ",")
    return c.select("id", F.concat_ws("|", "source.name", "source.connector_type").alias("source"), show("media", "block_index", "asset_id", "public_path", "mime_type").alias("media"), show("links", "position", "url", "label").alias("links"))


CHILDREN_SQL = q(
    """n as (select count(*) n from documents), a as (select event_id asset_id, event_id % n raw_item_id, (event_id // n) % 4 block_index, case when event_id % 5 = 0 then '/media/public/' || event_id end pub from events, n),
    m as (select raw_item_id id, string_agg(block_index || ':' || asset_id || ':' || coalesce(pub, '-') || ':' || case when pub is null or asset_id % 3 = 2 then '-' when asset_id % 3 = 0 then 'image/png' else 'image/jpeg' end, ',' order by block_index, asset_id) media from a group by 1),
    l as (select page_id % 70 id, string_agg((page_id // 70) || ':' || url || ':l' || page_id, ',' order by page_id // 70, url) links from pages group by 1)""",
    "select i.id, s.name || '|' || s.connector_type as source, coalesce(media, '') media, coalesce(links, '') links from item i left join src s on s.id = i.source_id left join m on m.id = i.id left join l on l.id = i.id",
)


def alert_cards(spark, d):
    """Cards of failed jobs and runs."""
    k = F.col("id")
    null = lambda t="string": F.lit(None).cast(t)
    rows = view(spark, d, "job").where("status = 'failed'").select(
        "id", F.when(k % 2 == 0, "collection_failure").when(k % 7 > 0, "pipeline_failure").otherwise("other").alias("kind"), F.concat(F.lit(" source "), (k % 20).cast("string")).alias("source_name"), _pick(k, V.CONNECTORS).alias("connector_type"), (k % 20).alias("source_id"),
        _pick(k, ("rate_limited", "network", "authentication")).alias("error_kind"), "attempts", null("long").alias("run_id"), F.col("stage"), "raw_item_id", k.alias("job_id"), F.when(k % 3 == 0, k * 2).alias("checkpoint_id"), F.lit("2024-01-01T00:00:00Z").alias("occurred_at"), F.repeat(F.lit("broken "), (k % 400).cast("int")).alias("error_summary"),
    ).withColumnRenamed("attempts", "failures")
    return reviews.alert_cards(rows, "Desk").select("id", F.sha2("body", 256).alias("digest"), F.length("body").alias("size"))


_STAGE = "case stage " + " ".join(f"when '{k}' then '{v}'" for k, v in reviews.STAGE_LABELS.items()) + " end"
CARDS_SQL = q(
    f"""f as (select *, id % 2 = 0 coll, 'source ' || id % 20 src, rtrim(repeat('broken ', (id % 400)::int)) s0 from job where status = 'failed' and (id % 2 = 0 or id % 7 > 0)),
    g as (select id, coll, case when coll then concat_ws('\\n', '来源：' || src, 'connector_type：' || ({_list(V.CONNECTORS)})[id % {len(V.CONNECTORS)} + 1], 'source_id：' || id % 20, '错误类别：' || case id % 3 when 0 then '请求限流' when 1 then 'network' else '登录失效' end, '连续失败：' || attempts, 'run：-', '发生时间：2024-01-01T00:00:00Z')
        else concat_ws('\\n', '阶段：' || {_STAGE}, 'raw_item：' || raw_item_id, 'job：' || id, 'run：-', '来源：' || src, 'checkpoint：' || case when id % 3 = 0 then (id * 2)::varchar else '-' end, '发生时间：2024-01-01T00:00:00Z') end details,
        case when s0 = '' then '-' when length(s0) <= 1200 then s0 else rtrim(s0[1:1199]) || '…' end summary from f),
    b as (select id, '{{"msg_type":"interactive","card":{{"config":{{"wide_screen_mode":true}},"header":{{"template":"red","title":{{"tag":"plain_text","content":"🚨 Desk ' || case when coll then '采集失败' else '处理失败' end || '"}}}},"elements":[{{"tag":"div","text":{{"tag":"lark_md","content":"' || details || '"}}}},{{"tag":"hr"}},{{"tag":"div","text":{{"tag":"lark_md","content":"**错误摘要**\\n' || summary || '"}}}}]}}}}' body from g)""",
    "select id, sha256(body) digest, length(body) as size from b",
)

# ---- small rules


def text_marks(spark, d):
    """Reposts by their text, authors without handle, types of media by address, waits before attempts."""
    k = F.col("id")
    text = F.concat(_pick(k, ("RT @Name_1 : ", "  rt @x:", "转发自 @", "Art @x: ", "said\n转发自  @y ")), F.coalesce("text", F.lit("")))
    author = F.concat(F.col("author"), _pick(k, (" (@handle)", "", " (@a(b))", "  (@x y)")))
    path = F.concat(F.lit("https://h.example.org/"), k.cast("string"), _pick(k, (".PNG?q=.gif", ".jpeg", ".webp#x", ".html", ".JPG/", "")))
    return view(spark, d, "raw").select("id", T.repost_evidence(text).alias("repost"), T.strip_handle(author).alias("author"), T.mime_of(path).alias("mime"), T.backoff_seconds(k % 6).alias("wait"))


MARKS_SQL = q(
    "z as (select 1)",
    """select id, id % 5 in (0, 1, 2, 4) or contains(coalesce(text, ''), chr(10) || '转发自 @') repost, author || case id % 4 when 2 then ' (@a(b))' else '' end author,
    case id % 6 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/webp' end mime, case id % 6 when 0 then 30 when 1 then 30 when 2 then 120 else 600 end as wait from raw""",
)


def search_between(spark, d):
    """Published messages of a half-open range of time."""
    page, _ = search.search_published(view(spark, d, "item").withColumn("topics", F.array("topic")), since_us=1_704_844_800_000_000, until_us=1_705_276_800_000_000, limit=100)
    return page.select("id", "seen_us")


BETWEEN_SQL = q("z as (select 1)", "select id, seen_us from item where status = 'published' and seen_us >= 1704844800000000 and seen_us < 1705276800000000 order by seen_us desc nulls first, id desc limit 100")


def report_regeneration(spark, d):
    """Days whose report is to be written again after what came late."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    day = search.civil_date(us)
    updates = _table(spark, d, "events").where("user_id % 7 = 0").select(F.date_sub(day, 1).cast("string").alias("report_date"), us.alias("updated_us"))
    due = daily.scheduled_instant(day)
    n = F.dayofmonth(day)
    days = _table(spark, d, "events").select(day.cast("string").alias("report_date"), due.alias("scheduled_us"), (due + F.when(n % 5 == 0, -60_000_000).otherwise(120_000_000)).alias("written_us"), (n % 6 == 0).alias("withdrawn")).distinct()
    return daily.needs_regeneration(days, updates, 15 * 60_000_000)


REGENERATION_SQL = """
with e as (select epoch_us(ts) us, user_id, ((epoch_us(ts) + 28800000000) // 86400000000)::int dn from events),
d as (select distinct dn, (dn + 1)::bigint * 86400000000 - 28800000000 due, day(date '1970-01-01' + dn) n from e),
w as (select *, due + case when n % 5 = 0 then -60000000 else 120000000 end written from d where n % 6 <> 0),
u as (select dn - 1 dn, max(us) us from e where user_id % 7 = 0 group by 1)
select (date '1970-01-01' + w.dn)::varchar report_date from w left join u using (dn) where written < due or (u.us > written and u.us <= due + 900000000)
"""


def quoted_posts(spark, d):
    """Messages whose blocks quote another post, and how much of their text is picked for a budget."""
    i = view(spark, d, "item")
    one = lambda kind, embed: F.struct(F.lit(kind).alias("type"), embed.alias("embed_kind"))
    blocks = F.array(one("paragraph", F.lit(None).cast("string")), one("embed", _pick(F.col("id"), ("quoted_post", "video", "poll"))), one("quote", F.lit("quoted_post")))
    picked = packing.pick_within(F.split("content", "\n"), F.array(F.lit("patch"), F.lit("free")), 300)
    return i.select("id", B.has_quoted_post(blocks).alias("quoted"), F.length(picked).alias("picked"))


QUOTED_SQL = q(
    """l as (select id, unnest(list_zip(range(0, len(string_split(content, chr(10)))::bigint), string_split(content, chr(10)))) z from item),
    o as (select id, trim(z[2], ' ') t, row_number() over (partition by id order by contains(lower(z[2]), 'patch')::int + contains(lower(z[2]), 'free')::int desc, z[1]) n from l where trim(z[2], ' ') <> ''),
    p as (with recursive w as (select id, 0::bigint n, 0::bigint used from item union all select o.id, o.n, case when used < 300 then used + least(length(t), 300 - used) + 1 else used end from w join o on o.id = w.id and o.n = w.n + 1) select id, max(used) used from w group by 1)""",
    "select id, id % 3 = 0 quoted, greatest(used - 1, 0)::int picked from p",
)


def manual_imports(spark, d):
    """Documents handed in by hand, as candidates."""
    k = F.col("doc_id")
    title = F.when(k % 4 > 0, F.concat(F.lit(" title "), k.cast("string"))).otherwise(" ")
    rows = _table(spark, d, "documents").select(F.to_json(F.struct(title.alias("title"), F.when(k % 7 == 3, "/relative").otherwise(F.concat(F.lit("https://h.example.org/"), k.cast("string"))).alias("url"), F.when(k % 5 > 0, F.col("text")).alias("content"), (F.when(k % 3 == 0, k)).alias("author"), F.concat(F.lit("2024-01-01T00:00:00"), _pick(k, ("Z", "+08:00", ""))).alias("published_at"))).alias("value"))
    c = connectors.collect(rows, "manual", "manual").candidates
    return c.select(F.coalesce(F.regexp_extract("native_title", r"(\d+)$", 1), F.lit("")).alias("number"), "canonical_url", "author_name", "published_us", F.array_join(F.transform("blocks", lambda b: T.strip(b["text"])), "|").alias("text"), F.coalesce("error", F.lit("")).alias("error"))


MANUAL_SQL = r"""
select case when doc_id % 4 > 0 then doc_id::varchar else '' end as "number", case when doc_id % 7 = 3 then '/relative' else 'https://h.example.org/' || doc_id end canonical_url, null::varchar author_name,
    case doc_id % 3 when 0 then 1704067200000000 when 1 then 1704038400000000 end published_us, case when doc_id % 5 > 0 then regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') else '' end as "text",
    case when doc_id % 3 = 2 then 'time needs a zone' when doc_id % 5 = 0 or coalesce(text, '') = '' then 'no content blocks' when doc_id % 7 = 3 then 'url must be absolute' else '' end error from documents
"""

QUERIES = {
    "review_corrections": review_corrections, "legal_label_sets": legal_label_sets, "ordered_topics": ordered_topics, "claim_fingerprints": claim_fingerprints, "messages_without_type": messages_without_type, "repost_accounts": repost_accounts, "message_children": message_children,
    "alert_cards": alert_cards, "text_marks": text_marks, "search_between": search_between, "report_regeneration": report_regeneration, "quoted_posts": quoted_posts, "manual_imports": manual_imports,
}
SQL = {
    "review_corrections": CORRECTIONS_SQL, "legal_label_sets": LEGAL_SQL, "ordered_topics": TOPICS_SQL, "claim_fingerprints": CLAIMS_SQL, "messages_without_type": TYPES_SQL, "repost_accounts": ACCOUNTS_SQL, "message_children": CHILDREN_SQL,
    "alert_cards": CARDS_SQL, "text_marks": MARKS_SQL, "search_between": BETWEEN_SQL, "report_regeneration": REGENERATION_SQL, "quoted_posts": QUOTED_SQL, "manual_imports": MANUAL_SQL,
}
