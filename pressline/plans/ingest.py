"""Queries over ingestion, evaluation and operations; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import blocks as B
from pressline.functions import entities as N
from pressline.functions import text as T
from pressline.functions import vocab as V
from pressline.operators import ingest, messages, ops, recall, search
from pressline.plans.events import _mentions
from pressline.plans.sql_events import q
from pressline.sources import html_blocks, platforms
from pressline.sources.adapter import view


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def candidate_recall(spark, d):
    items = view(spark, d, "item").where("status = 'published'").withColumn("topics", F.array("topic")).withColumn("anchors", F.array(F.concat(F.lit("e"), F.col("id") % 50), F.concat(F.lit("f"), F.col("id") % 7)))
    stories = view(spark, d, "story").withColumn("anchors", F.array(F.concat(F.lit("e"), F.col("id") % 50), F.concat(F.lit("f"), F.col("id") % 3))).withColumn("last_seen_us", F.col("last_seen_us"))
    return recall.recall_candidates(items, stories)


def _arrivals(spark, d):
    """Documents that arrive under one of 200 keys, a third of them twice; the content is
    the whole text and its language."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    content = F.sha2(F.concat_ws("\n", T.detect_language(text), lang, text), 256)
    docs = _table(spark, d, "documents").select(F.pmod("doc_id", F.lit(200)).alias("key"), content.alias("content_hash"), F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).otherwise(F.array(F.col("doc_id") * 2))).alias("arrival"))
    return docs.select("key", "arrival", "content_hash")


def content_revisions(spark, d):
    return ingest.revisions(_arrivals(spark, d)).select("key", "arrival", "action", "revision", "supersedes", "content_hash")


def _blocks(spark, d):
    """Documents as raw blocks: the first line a heading, every fourth a list, the rest paragraphs."""
    lines = F.split("content", "\n")
    kind = lambda i: F.when(i == 0, " Heading").when(i % 4 == 3, "LIST").otherwise("paragraph")
    null = F.lit(None)

    def one(x, i):
        fields = {"type": kind(i), "text": F.when(i % 4 != 3, x), "items": F.when(i % 4 == 3, F.split(x, ", ")), "level": F.lit(9)}
        return F.struct(*(fields.get(n, null).cast("int" if n == "level" else "array<string>" if n == "items" else "boolean" if n == "ordered" else "string").alias(n) for n in B.FIELDS))

    return view(spark, d, "item").select("id", F.filter(F.transform(lines, one), lambda b: (F.trim(F.coalesce(b["text"], F.lit(""))) != "") | (F.size(F.filter(F.coalesce(b["items"], F.array().cast("array<string>")), lambda v: F.trim(v) != "")) > 0)).alias("blocks"))


def block_normalize(spark, d):
    checked = _blocks(spark, d).select("id", B.checked_blocks(F.col("blocks")).alias("checked"))
    n = checked.select("id", F.coalesce(B.first_error(F.col("checked")), F.lit("")).alias("error"), F.explode("checked").alias("c")).select("id", "error", F.col("c.block").alias("b"))
    return n.select("id", "error", F.col("b.id").alias("block_id"), F.col("b.type").alias("type"), F.col("b.level").alias("level"), F.coalesce("b.text", F.array_join("b.items", "|")).alias("text"))


def block_text(spark, d):
    return _blocks(spark, d).select("id", B.block_text(B.normalize_blocks(F.col("blocks"))).alias("text"))


def block_hash(spark, d):
    return _blocks(spark, d).select("id", B.content_hash(B.normalize_blocks(F.col("blocks"))).alias("content_hash"))


_TYPES = ("hero", "patch", "club", "league", "player", "mode")
_NAMES = ("Ahri", "14.3", "Team One", "The LPL spring", "Faker", "ARAM ", "  ", "Ahri")


def _entities(spark, d):
    """Six entities per document, types and names by its id, some aliased, equal or empty."""
    kinds, names = F.array(*map(F.lit, _TYPES)), F.array(*map(F.lit, _NAMES))
    one = lambda i: F.struct(F.element_at(kinds, (i % 6 + 1).cast("int")).alias("type"), F.element_at(names, ((F.col("id") + i) % 8 + 1).cast("int")).alias("name"), F.when(i % 2 == 0, "CORE").alias("role"))
    rows = view(spark, d, "raw").select("id", F.transform(F.sequence(F.col("id") % 3, F.col("id") % 3 + 5), one).alias("entities"))
    return N.compatible_entities(rows).select("id", N.normalize_entities(F.col("entities")).alias("entities"))


def entity_normalize(spark, d):
    e = _entities(spark, d).select("id", F.posexplode("entities").alias("pos", "e"))
    return e.select("id", "pos", "e.type", "e.canonical_name", "e.canonical_id", "e.role")


def anchors(spark, d):
    a = _entities(spark, d).select("id", F.explode(N.anchors(F.col("entities"))).alias("anchor", "values"))
    return a.select("id", "anchor", F.array_join("values", ",").alias("values"))


def _reposts(spark, d):
    """Messages beside a page's url as their upstream."""
    pages = _table(spark, d, "pages").select(F.col("page_id").alias("_p"), F.col("url").alias("upstream"))
    n = pages.agg(F.count("*")).scalar()
    items = view(spark, d, "item").select("id", "content_form", "source_id", (F.col("id") % 6).isin(0, 3).alias("is_official"), (F.col("id") % n).alias("_p"))
    return items.join(pages, "_p", "left")


def crossfeed_candidates(spark, d):
    """Records under another account's address that name no record they repeat."""
    author = F.lower(F.split_part("url", F.lit("/"), F.lit(4)))
    payload = F.concat(F.lit('{"retweet":'), F.when(F.col("page_id") % 3 == 0, '{"id":"7"}').when(F.col("page_id") % 3 == 1, "null").otherwise('{"id":null}'), F.lit("}"))
    rows = _table(spark, d, "pages").select("page_id", "url", author.alias("author"), payload.alias("payload"))
    own = F.col("url").rlike(r"^https?://(blog|m)\.") & (F.col("author") != "en")
    return rows.where(own & F.get_json_object("payload", "$.retweet.id").isNull()).select("page_id", "author")


SITES = (("example.com", True), ("example.org", False), ("thther.example.net", True), ("example.net", False))


def evaluation_rows(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "n_chars")
    actual = F.when(F.col("doc_id") % 9 != 0, F.when(F.col("n_chars") > 500, 1).otherwise(0))
    joined = _table(spark, d, "labels").join(docs, "doc_id")
    both = [joined.select(F.lit(t).alias("task"), F.col(t).cast("int").alias("expected"), actual.alias("actual")) for t in ("quality", "toxic")]
    return ops.accuracy(both[0].unionByName(both[1]))


def eval_membership(spark, d):
    """Expected against predicted memberships of each message: every seventh is predicted wrong."""
    m = view(spark, d, "mention_all").withColumn("w", F.when(F.col("id") % 7 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")))
    one = lambda e: F.struct(F.lit("attach").alias("action"), F.col(e).cast("string").alias("event_key"), F.lit(None).cast("string").alias("event_family"), F.col("relation"))
    g = m.groupBy("item_id").agg(F.sort_array(F.collect_list(one("event_id"))).alias("e"), F.sort_array(F.collect_list(one("w"))).alias("p"))
    o = g.select("item_id", ops.membership_outcome(F.col("e"), F.col("p")).alias("o"))
    return o.select("item_id", F.col("o.missing").cast("long").alias("missing"), F.col("o.extra").cast("long").alias("extra"))


def _alerts(spark, d):
    e = _table(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def outbox_dedup(spark, d):
    a = _alerts(spark, d).withColumn("dedupe_key", F.concat_ws(":", F.lit("err"), F.col("user_id").cast("string"), F.floor(F.col("us") / F.lit(86_400_000_000)).cast("string")))
    return ingest.insert_new(a.where("user_id % 5 = 0"), a, "dedupe_key").select("id", "user_id", "dedupe_key")


def memberships(spark, d):
    """Decisions of all mentions: attach, create or ignore."""
    m = view(spark, d, "mention_all")
    action = F.element_at(F.array(*map(F.lit, ("attach", "create", "attach", "ignore"))), (F.col("id") % 4 + 1).cast("int"))
    return ingest.memberships(m.select("item_id", "item_revision", "mention_index", "policy", action.alias("action"), "event_id", "relation"))


def cursor_advance(spark, d):
    """Batches of a thousand events per source, two in three truncated."""
    e = _table(spark, d, "events").select((F.col("user_id") % 10).alias("source"), F.floor(F.col("event_id") / 1000).alias("batch"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    b = e.groupBy("source", "batch").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("ids"), F.max("us").alias("high_us"))
    return ingest.advance_cursor(b.withColumn("truncated", (F.col("batch") + F.col("source")) % 3 != 0))


def published_labels(spark, d):
    i = view(spark, d, "item").withColumns({"topics": F.array("topic"), "importance": F.col("importance_score"), "priority": F.col("priority_score")})
    return messages.published_labels(i).select("id", "message_type", F.array_join("topics", ",").alias("topics"), "importance", "priority")


def patch_previews(spark, d):
    i, account = view(spark, d, "item"), F.when(F.col("source_id") % 2 == 0, "RiotPhroxzon").otherwise("other")
    found = messages.is_patch_preview(F.col("id") % 2 == 0, F.col("title"), F.col("content"), F.lit("x_twitter"), account)
    return i.where(found).select("id")


def schedule_next_run(spark, d):
    """The next run of each collection, from the runs of its source."""
    r = view(spark, d, "job")
    due = ops.next_run(F.col("created_us"), F.col("id") % 10 > 0, F.col("status") == "completed", F.col("attempts") == 0, F.lit(30), F.col("attempts") * 5)
    return r.select("id", due.alias("next_us"))


QUERIES = {
    "candidate_recall": candidate_recall,
    "content_revisions": content_revisions,
    "supersede_cascade": lambda s, d: ingest.supersede_cascade(view(s, d, "raw"), view(s, d, "item"), view(s, d, "job")),
    "block_normalize": block_normalize,
    "block_text": block_text,
    "block_hash": block_hash,
    "entity_normalize": entity_normalize,
    "anchors": anchors,
    "html_blocks": lambda s, d: html_blocks.html_blocks(_table(s, d, "pages")).withColumn("items", F.array_join("items", "|")),
    "html_links": lambda s, d: html_blocks.page_links(_table(s, d, "pages")),
    "thread_blocks": lambda s, d: platforms.thread_text(_table(s, d, "conversations")),
    "crossfeed_candidates": crossfeed_candidates,
    "independence_groups": lambda s, d: _reposts(s, d).select("id", ops.independence_group(F.col("content_form"), F.col("source_id"), F.col("upstream")).alias("independence_group")),
    "source_roles": lambda s, d: view(s, d, "mention_all").join(view(s, d, "item").select(F.col("id").alias("item_id"), "content_form", (F.col("id") % 6).isin(0, 3).alias("is_official")), "item_id").select("id", ops.verified_role(F.col("source_role"), F.col("content_form"), F.col("is_official")).alias("source_role")),
    "classification_source": lambda s, d: ops.classification_source(_reposts(s, d), s.createDataFrame(list(SITES), "site string, official boolean")),
    "ops_metrics_jobs": lambda s, d: ops.job_metrics(view(s, d, "job")),
    "ops_metrics_batch": lambda s, d: ops.batch_status(view(s, d, "raw").select("id"), view(s, d, "job")),
    "review_stages": lambda s, d: ops.review_stages(view(s, d, "job")),
    "knowledge_conflicts": lambda s, d: ops.knowledge_conflicts(
        view(s, d, "raw").select("id", F.concat(F.lit("scope "), F.col("source_id")).alias("scope"), F.concat(F.lit(" Key"), F.col("id") % 300).alias("constraint_key"), F.concat(F.lit("Rule  "), F.floor(F.col("id") / 300) % 2).alias("rule_text"), (F.col("id") % 4 > 0).alias("active"))
    ),
    "reliability_calibration": lambda s, d: view(s, d, "src").select("id", ops.reliability(F.col("connector_type"), F.col("external_key"), F.col("name")).alias("reliability")),
    "evidence_projection_sql": lambda s, d: ops.evidence_projection(_mentions(s, d)),
    "eval_accuracy": evaluation_rows,
    "eval_membership": eval_membership,
    "alert_cooldown": lambda s, d: ingest.first_in_bucket(_alerts(s, d), ["user_id"], 6 * 3600),
    "outbox_dedup": outbox_dedup,
    "memberships": memberships,
    "membership_conflicts": lambda s, d: ingest.membership_conflicts(view(s, d, "mention_all").select("item_id", "item_revision", "mention_index", "policy", F.lit("attach").alias("action"), "event_id")),
    "cursor_advance": cursor_advance,
    "raw_item_status": lambda s, d: search.raw_status(view(s, d, "raw"), view(s, d, "item"), view(s, d, "run")),
    "published_labels": published_labels,
    "patch_previews": patch_previews,
    "schedule_next_run": schedule_next_run,
    "table_counts": lambda s, d: ops.table_counts({n: view(s, d, n) for n in ("raw", "item", "mention", "story")}),
}

_words = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+|[一-鿿]'))"
_pf = ", ".join(f"('{p}', '{f}')" for p, fs in V.PRODUCT_EVENT_FAMILIES.items() for f in fs)
_tf = ", ".join(f"('{t}', '{f}')" for t, fs in V.TOPIC_EVENT_FAMILIES.items() for f in fs)
RECALL = f"""
pf as (select * from (values {_pf}) v(p, f)), tf as (select * from (values {_tf}) v(t, f)),
al as (select distinct i.id, pf.f, exists (select 1 from tf where tf.t = i.topic and tf.f = pf.f) routed from item i join pf on list_contains(i.products, pf.p)),
fam as (select id, f from al a where routed or not exists (select 1 from al b where b.id = a.id and b.routed) union all select id, 'other_named_development' from item where products = ['unknown']),
ne as (select * from story order by last_seen_us desc nulls first, id desc limit 500),
e as (select n.*, {_words("title || ' ' || summary")} w from ne n where len(products) <> 1 or products = ['unknown'] or exists (select 1 from pf where pf.p = n.products[1] and pf.f = n.event_family)),
i as (select *, {_words("concat_ws(' ', nullif(title, ''), nullif(summary, ''), content[1:4000])")} w from item where status = 'published'),
c0 as (select i.id item_id, e.id event_id, list_has_any(i.products, e.products) same, (i.id % 50 = e.id % 50)::int + (i.id % 7 = e.id % 3)::int ents, len(list_intersect(i.w, e.w)) shared, len(list_distinct(list_concat(i.w, e.w))) total, i.seen_us, e.last_seen_us, e.created_us
   from i join fam on fam.id = i.id join e on e.event_family = fam.f and (i.products = ['unknown'] or (len(e.products) = 1 and list_contains(i.products, e.products[1]))) and (e.last_seen_us is null or e.last_seen_us >= i.seen_us - 60 * 86400000000)),
c as (select item_id, event_id, 30.0::double + case when same then 20.0 else 0.0 end + 10 * ents + 30 * (shared::double / total) + greatest(0.0, 20 * (1 - abs(seen_us - coalesce(last_seen_us, created_us)) / 86400000000.0::double / 60)) score,
   'family_hint' || case when same then ',product_overlap' else '' end || case when ents > 0 then ',entity_overlap' else '' end || case when shared > 0 then ',text_overlap' else '' end || ',recent_activity' reasons from c0),
r as (select *, row_number() over (partition by item_id order by score desc, event_id desc) as position from c)"""
ARR = r"""with l as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') as body, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) vis, length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) han from documents),
a as (select doc_id % 200 as key, unnest(case when doc_id % 3 = 0 then [doc_id * 2, doc_id * 2 + 1] else [doc_id * 2] end) arrival, sha256(case when vis = 0 then 'unknown' when han / vis >= 0.1 then 'zh-CN' else 'en' end || chr(10) || lang || chr(10) || body) content_hash from l),
b as (select *, lag(content_hash) over (partition by key order by arrival) is distinct from content_hash c from a),
r as (select *, sum(c::int) over (partition by key order by arrival)::bigint revision, last_value(case when c then arrival end ignore nulls) over (partition by key order by arrival rows between unbounded preceding and 1 preceding) prev from b)"""
BLK = r"""
ln as (select id, unnest(list_zip(string_split(content, chr(10)), range(0, len(string_split(content, chr(10)))::bigint))) z from item),
l1 as (select id, z[1] x, z[2] i from ln), l2 as (select id, i, case when i = 0 then 'heading' when i % 4 = 3 then 'list' else 'paragraph' end as type, trim(x) t, list_filter(list_transform(string_split(x, ', '), lambda v: trim(v)), lambda v: v <> '') items from l1),
l3 as (select *, row_number() over (partition by id order by i) n from l2 where case when i % 4 = 3 then len(items) > 0 else t <> '' end)"""
ENT = """
e0 as (select id, unnest(range(id % 3, id % 3 + 6)) i from raw),
e1 as (select id, i - id % 3 pos, (['hero', 'patch', 'club', 'league', 'player', 'mode'])[i % 6 + 1] ty, trim((['Ahri', '14.3', 'Team One', 'The LPL spring', 'Faker', 'ARAM ', '  ', 'Ahri'])[(id + i) % 8 + 1]) nm, i % 2 = 0 core from e0),
e2 as (select id, pos, case ty when 'hero' then 'champion' when 'club' then 'team' when 'mode' then 'game_mode' else ty end as type, nm, case when core then 'core' else 'context' end as role from e1 where nm <> ''),
e3 as (select *, case when type = 'league' then (case when regexp_matches(lower(nm), '(^|[^a-z])lpl($|[^a-z])') then 'lpl' when len(regexp_extract_all(lower(nm), '[a-z][a-z0-9]+')) = 1 then regexp_extract(lower(nm), '[a-z][a-z0-9]+') else nm end) else nm end canonical_name from e2),
e4 as (select *, type || ':' || regexp_replace(lower(canonical_name), '[^a-z0-9_]+', '-', 'g') canonical_id from e3),
e5 as (select *, row_number() over (partition by id, canonical_id order by pos) rn from e4),
e6 as (select *, row_number() over (partition by id order by pos) - 1 p from e5 where rn = 1)"""
_site = ", ".join(f"('{s}', {o})" for s, o in SITES)
REP = "rp as (select i.id, i.content_form, i.source_id, i.id % 6 in (0, 3) is_official, p.url upstream from item i left join pages p on p.page_id = i.id % (select count(*) from pages))"
_host = r"lower(regexp_extract(upstream, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SQL = {
    "raw_item_status": q("r as (select raw_item_id id, arg_max(status, id) st from run group by 1)", "select w.id, case when st in ('running', 'awaiting_review', 'failed') then st when i.status = 'published' then 'analyzed' else 'pending' end status from raw w left join r on r.id = w.id left join item i on i.id = w.id"),
    "published_labels": q("b as (select *, content_form in ('media_only', 'link_only') bare from item)", "select id, case when bare then 'unknown' else message_type end message_type, case when bare then 'unknown' else topic end topics, case when bare then 0 else importance_score end importance, case when bare then 0 else priority_score end priority from b"),
    "patch_previews": q("z as (select 1)", "select id from item where id % 2 = 0 and source_id % 2 = 0 and regexp_matches(lower(title || chr(10) || content), 'preview|micropatch|hotfix')"),
    "schedule_next_run": q("z as (select 1)", "select id, case when id % 10 > 0 then created_us + 60000000 * (case when status = 'completed' then (case when attempts = 0 then 1 else 30 end) else attempts * 5 end) end next_us from job"),
    "table_counts": q("z as (select 1)", "select 'raw' as \"table\", count(*) n from raw union all select 'item', count(*) from item union all select 'mention', count(*) from mention union all select 'story', count(*) from story"),
    "candidate_recall": q(RECALL, "select item_id, event_id, round(score, 4) score, reasons, position from r where position <= 12"),
    "content_revisions": f"{ARR} select key, arrival, case when not c then 'skip' when revision = 1 then 'create' else 'revise' end as action, revision, case when c then prev end supersedes, content_hash from r",
    "supersede_cascade": q("o as (select distinct supersedes as id from raw where supersedes is not null), a as (select raw_item_id id, count(*) n from job where status in ('queued', 'running') group by 1)", "select o.id, case when i.status = 'withdrawn' then 'withdrawn' else 'superseded' end item_status, coalesce(a.n, 0) cancelled_jobs from o left join item i on i.id = o.id left join a on a.id = o.id"),
    "block_normalize": q(BLK, "select id, '' error, printf('b%04d', n) block_id, type, case when type = 'heading' then 6 end as level, case when type = 'list' then array_to_string(items, '|') else t end as text from l3"),
    "block_text": q(BLK, "select i.id, coalesce((select string_agg(case when type = 'list' then array_to_string(items, chr(10)) else t end, chr(10) || chr(10) order by n) from l3 where l3.id = i.id), '') as text from item i"),
    "block_hash": q(
        BLK + """,
        j as (select id, n, '{"id":"' || printf('b%04d', n) || '",' || case type when 'list' then '"items":' || to_json(items)::varchar || ',"ordered":false,' when 'heading' then '"level":6,"text":' || to_json(t)::varchar || ',' else '"text":' || to_json(t)::varchar || ',' end || '"type":"' || type || '"}' x from l3)""",
        "select i.id, sha256('[' || coalesce((select string_agg(x, ',' order by n) from j where j.id = i.id), '') || ']') content_hash from item i",
    ),
    "cursor_advance": """with recursive b as (select user_id % 10 source, event_id // 1000 as batch, list(event_id::varchar) ids, max(epoch_us(ts)) h from events group by 1, 2),
        o as (select *, row_number() over (partition by source order by batch) n, (batch + source) % 3 <> 0 held from b),
        w as (select distinct source, 0::bigint n, null::bigint watermark, null::bigint high, []::varchar[] pending from b
          union all select o.source, o.n, case when held then watermark else greatest(watermark, high, h) end, case when held then greatest(high, h) end, case when held then list_distinct(list_concat(pending, ids)) else [] end from w join o on o.source = w.source and o.n = w.n + 1)
        select source, watermark watermark_us, high pending_high_us, array_to_string(list_sort(pending), ',') pending_ids from w qualify row_number() over (partition by source order by n desc) = 1""",
    "entity_normalize": q(ENT, "select id, p pos, type, canonical_name, canonical_id, role from e6"),
    "anchors": q(ENT, "select id, case type when 'patch' then 'patch_version' else type end anchor, string_agg(canonical_id, ',' order by p) as \"values\" from e6 group by 1, 2"),
    "html_blocks": r"""
        with p as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) nav, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) head, regexp_split_to_array(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<p(?: [^>]*)?>') body from pages),
        b as (select page_id, 0 n, 'list' as type, null as body, null::int as level, array_to_string(list_filter(list_transform(regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', ' ', 'g'))), lambda x: x <> ''), '|') as items, false as ordered from p
            union all select page_id, 1, 'heading', head, 1, null, null from p
            union all select page_id, n, 'paragraph', body[n], null, null, null from (select page_id, body, unnest(range(2, len(body) + 1)) n from p)),
        e as (select *, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g')) as t from b),
        c as (select page_id, n, type, level, ordered, replace(replace(replace(replace(items, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as items, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as text from e)
        select page_id, (row_number() over (partition by page_id order by n) - 1)::int as ord, type, text, level, items, ordered, null::varchar as source_url, null::varchar as mime_type, null::varchar as alt_text, null::varchar as caption, null::varchar as embed_kind from c where coalesce(text, items) <> ''""",
    "html_links": "select distinct page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) link from pages",
    "thread_blocks": "select conv_id, count(*) n_posts, string_agg('Floor ' || turn || chr(10) || chr(10) || trim(text), chr(10) || chr(10) order by turn, text) as text from conversations where role = 'user' and length(trim(text)) > 0 group by 1",
    "crossfeed_candidates": r"select page_id, lower(split_part(url, '/', 4)) author from pages where regexp_matches(url, '^https?://(blog|m)\.') and lower(split_part(url, '/', 4)) <> 'en' and page_id % 3 > 0",
    "independence_groups": q(REP, f"select id, case when content_form = 'repost' then (case when {_host} <> '' then 'upstream:https://' || {_host} || regexp_replace(regexp_extract(upstream, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') end) else 'source:' || source_id end independence_group from rp"),
    "source_roles": q("z as (select 1)", "select m.id, case when source_role <> 'responsible_official' then source_role when content_form = 'repost' then 'republisher' when i.id % 6 not in (0, 3) then 'unknown' else source_role end source_role from mention_all m join item i on i.id = m.item_id"),
    "classification_source": q(
        f"{REP}, st as (select * from (values {_site}) v(site, official)), h as (select *, regexp_replace({_host}, '^www\\.', '') h from rp), m as (select h.id, count(*) n, bool_or(official) up from h join st on h.h = site or h.h like '%.' || site where content_form = 'repost' group by 1)",
        "select h.id, case when content_form <> 'repost' then (case when is_official then 'official' else 'unofficial' end) when n = 1 then (case when up then 'official' else 'unofficial' end) else 'unknown' end source_kind, case when content_form <> 'repost' then 'current' when n = 1 then 'upstream' else 'unresolved' end basis from h left join m on m.id = h.id",
    ),
    "ops_metrics_jobs": q("z as (select 1)", "select stage, status, count(*) n, sum(recovery_count)::bigint recovered, min(case when status = 'queued' then created_us end) oldest_queued_us from job group by 1, 2"),
    "ops_metrics_batch": q("j as (select raw_item_id id, arg_max(status, id) status from job group by 1)", "select coalesce(j.status, 'missing') status, count(*) n from raw left join j on j.id = raw.id group by 1"),
    "review_stages": q("f as (select raw_item_id, stage, min(id) id from job group by 1, 2)", "select raw_item_id, string_agg(stage, ',' order by id) stages from f group by 1"),
    "knowledge_conflicts": q("k as (select id, 'scope ' || source_id as scope, lower('key' || id % 300) constraint_key, 'rule ' || (id // 300) % 2 said from raw where id % 4 > 0)", "select scope, constraint_key, count(distinct said) texts, string_agg(id, ',' order by id) ids from k group by 1, 2 having count(distinct said) > 1"),
    "reliability_calibration": q("z as (select 1)", "select id, (case when connector_type in ('riot_official', 'tencent_lol') then 1.0 when connector_type in ('weibo', 'x_twitter', 'baidu_tieba') then 0.55 else 0.5 end)::double reliability from src"),
    "evidence_projection_sql": q("z as (select 1)", "select event_id, count(distinct independence_group) filter (relation = 'denies') denying_groups, count(distinct independence_group) filter (relation in ('reports', 'supports', 'confirms', 'corrects')) supporting_groups, bool_or(source_role = 'responsible_official') has_official, max(time_us) filter (materiality = 'material_update') material_us from mention group by 1"),
    "eval_accuracy": "with j as (select l.doc_id, quality, toxic, case when l.doc_id % 9 <> 0 then (n_chars > 500)::int end actual from labels l join documents using (doc_id)), u as (select 'quality' task, quality expected, actual from j union all select 'toxic', toxic, actual from j) select coalesce(task, 'all') task, count(*) total, count(*) filter (expected = actual) matched, count(*) filter (actual is null) missing, round(count(*) filter (expected = actual) / count(*), 6) accuracy from u group by rollup (task)",
    "eval_membership": q(
        "e as (select item_id, event_id k, relation r, count(*) n from mention_all group by all), p as (select item_id, case when id % 7 = 0 then event_id + 1 else event_id end k, relation r, count(*) n from mention_all group by all)",
        "select coalesce(e.item_id, p.item_id) item_id, sum(greatest(coalesce(e.n, 0) - coalesce(p.n, 0), 0))::bigint missing, sum(greatest(coalesce(p.n, 0) - coalesce(e.n, 0), 0))::bigint extra from e full join p on e.item_id = p.item_id and e.k = p.k and e.r = p.r group by 1",
    ),
    "alert_cooldown": "with a as (select event_id id, user_id, epoch_us(ts) us, epoch_us(ts) // 21600000000 as bucket from events where event_type = 'error') select user_id, bucket, arg_min(id, (us, id)) id, min(us) us, count(*) n from a group by 1, 2",
    "outbox_dedup": "with a as (select event_id id, user_id, 'err:' || user_id || ':' || (epoch_us(ts) // 86400000000) dedupe_key from events where event_type = 'error') select min(id) id, user_id, dedupe_key from a where user_id % 5 <> 0 group by 2, 3",
    "memberships": q(
        "d as (select item_id, item_revision, mention_index, policy, relation, case id % 4 when 1 then 'new:' || item_id || ':' || item_revision || ':' || mention_index || ':' || policy else 'event:' || event_id end event_key from mention_all where id % 4 <> 3)",
        "select item_id, item_revision, mention_index, policy, min(event_key) event_key, min(relation) relation from d group by 1, 2, 3, 4 having count(distinct event_key) = 1",
    ),
    "membership_conflicts": q("z as (select 1)", "select item_id, item_revision, mention_index, policy, count(distinct event_id) targets from mention_all group by 1, 2, 3, 4 having count(distinct event_id) > 1"),
}
