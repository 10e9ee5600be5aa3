"""Queries over message details, rules, notifications, review and restarts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import text as T
from pressline.functions import vocab as V
from pressline.operators import detail as D
from pressline.operators import events as E
from pressline.operators import daily, ingest, ops, search
from pressline.plans.events import _mentions, as_of
from pressline.plans.sql_events import HEAT, q
from pressline.sources.adapter import known, view


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lits(values):
    return F.array(*map(F.lit, values))


def _pick(x, values):
    return F.element_at(_lits(values), (x % len(values) + 1).cast("int"))


# ---- media overlay


def _assets(spark, d):
    """Media of messages: published, servable and private ones by the event's id."""
    i, n = F.col("event_id"), known(spark, d)["documents"]
    path = F.concat(_pick(i, ("/media/x/", "/media/private/", "/api/", "/media/w/")), i.cast("string"))
    return _table(spark, d, "events").select(i.alias("asset_id"), (i % n).alias("raw_item_id"), F.floor(i / n % 4).cast("int").alias("block_index"), F.when(i % 5 == 0, F.concat(F.lit("/media/public/"), i.cast("string"))).alias("public_path"), path.alias("storage_path"))


def public_blocks(spark, d):
    one = lambda kind, text, path: F.struct(F.lit(kind).alias("type"), text.alias("text"), path.alias("storage_path"))
    null = F.lit(None).cast("string")
    blocks = F.array(
        one("image", null, F.lit("/media/private/a")), one("paragraph", F.col("title"), F.lit("/media/b")), one("image", null, F.lit("/media/c")), one("image", null, null), one("image", null, F.lit("/api/d")),
    )
    items = view(spark, d, "item").select("id", blocks.alias("blocks"))
    seen = items.join(D.media_by_block(_assets(spark, d)), "id", "left").select("id", D.public_blocks(F.col("blocks"), F.col("public"), F.col("stored")).alias("b"))
    return seen.select("id", F.posexplode("b").alias("pos", "x")).select("id", "pos", "x.type", "x.storage_path")


# ---- rules, glossary, options


def scoped_rules(spark, d):
    k = F.col("p_partkey")
    scope = F.when(k % 3 == 0, "global").when(k % 3 == 1, F.concat(F.lit("connector:"), _pick(F.floor(k / 3), V.CONNECTORS))).otherwise(F.concat(F.lit("source:"), (F.floor(k / 3) % 20).cast("string")))
    rules = _table(spark, d, "part").select(k.alias("id"), scope.alias("scope"), (k % 4).alias("version"), F.concat(F.lit("rule "), k.cast("string")).alias("rule_text"), (k % 10 != 0).alias("active"), (k * 7919 % 10007).alias("updated_us"))
    return D.scoped_rules(view(spark, d, "src"), rules)


TERMS = [("Patch", "版本"), ("skin", "皮肤"), ("Finals", "决赛"), ("Champions", "英雄"), ("lottery", "抽奖"), ("chroma", "炫彩"), ("抽奖", "lottery"), ("no such term", "无")]


def glossary_hits(spark, d):
    terms = spark.createDataFrame([(a, b, i != 3, i) for i, (a, b) in enumerate(TERMS)], "term string, translation string, active boolean, updated_us long")
    return D.glossary_hits(view(spark, d, "item").select("id", F.col("content").alias("text")), terms)


def source_options(spark, d):
    latest = search.latest_raw(view(spark, d, "raw")).select(F.col("source_id").alias("id"))
    return view(spark, d, "src").select("id", "name").join(latest, "id", "left_semi").distinct()


def message_type_options(spark, d):
    """Types in use, and the word null if a latest raw item has no message."""
    types = view(spark, d, "item").where("length(message_type) > 0").select(F.col("message_type").alias("option")).distinct()
    bare = search.latest_raw(view(spark, d, "raw")).join(view(spark, d, "item").select(F.col("raw_item_id").alias("id")), "id", "left_anti").limit(1)
    return types.unionByName(bare.select(F.lit("null").alias("option")))


# ---- projections


def projection_restore(spark, d):
    """Every mention left a revision; four in five carry a snapshot."""
    m = _mentions(spark, d)
    snap = F.struct(F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("state "), (F.col("id") % 7).cast("string")).alias("current_summary"), _pick(F.col("id"), ("confirmed", "resolved", "denied", None, "developing")).alias("lifecycle_status"))
    revisions = view(spark, d, "mention_all").select("event_id", "item_id", "item_revision", "mention_index", "policy", F.when(F.col("id") % 5 > 0, snap).alias("snapshot"))
    events = view(spark, d, "story").select(F.col("id").alias("event_id"), "title", F.col("summary").alias("current_summary"))
    return E.restored_projection(events, m, revisions)


def membership_totals(spark, d):
    """Expected memberships against predictions, which every 17th message lacks and every seventh mention has wrong."""
    m = view(spark, d, "mention_all").withColumn("w", F.when(F.col("id") % 7 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")))
    one = lambda e: F.struct(F.lit("attach").alias("action"), F.col(e).cast("string").alias("event_key"), F.lit(None).cast("string").alias("event_family"), F.col("relation"))
    g = m.groupBy("item_id").agg(F.sort_array(F.collect_list(one("event_id"))).alias("expected"), F.sort_array(F.collect_list(one("w"))).alias("predicted"))
    return ops.membership_totals(g.withColumn("predicted", F.when(F.col("item_id") % 17 != 0, F.col("predicted"))))


def decision_errors(spark, d):
    m = view(spark, d, "mention_all")
    i = view(spark, d, "item").select(F.col("id").alias("item_id"), "products", "product", "content_form")
    action = _pick(F.col("id"), ("attach", "create", "ignore", "merge", "attach"))
    family = _pick(F.col("id"), ("esports_match", "gameplay_balance", "no_such_family"))
    error = ingest.decision_error(
        action, F.when(F.col("id") % 4 != 0, F.col("event_id")), F.array("event_id", F.col("event_id") + 1), F.when(F.col("id") % 6 == 0, "tft").otherwise(F.col("product")), F.col("products"), family,
        _lits(V.EVENT_FAMILIES), F.col("content_form") == "repost",
    )
    return m.join(i, "item_id").select("id", F.coalesce(error, F.lit("")).alias("error"))


# ---- work


def claimable_jobs(spark, d):
    now = view(spark, d, "job").agg(F.max("created_us")).first()[0]
    jobs = view(spark, d, "job").withColumn("status", F.when((F.col("status") == "completed") & (F.col("id") % 3 == 0), "running").otherwise(F.col("status")))
    jobs = jobs.withColumns({"next_attempt_us": F.when(F.col("id") % 2 == 0, F.col("created_us") + F.col("attempts") * 10_000_000_000_000), "lease_us": F.when(F.col("id") % 7 > 0, F.col("created_us") + 3_000_000_000_000)})
    return D.claimable(jobs, now, attempts=3).select("id", "status", "attempts")


def stale_events(spark, d):
    events = view(spark, d, "story").select("id", F.col("last_seen_us").alias("calculated_us"))
    return D.stale_events(events, known(spark, d)["latest_us"], ttl_s=86_400)


def ttl_refresh(spark, d):
    """Scores of the events that are due, computed again."""
    due = stale_events(spark, d).select(F.col("id").alias("event_id"))
    return E.event_heat(_mentions(spark, d).join(due, "event_id", "left_semi"), as_of(spark, d))


def _checkpoints(spark, d):
    j = view(spark, d, "job")
    return j.select("id", "raw_item_id", _pick(F.col("o_custkey") + F.col("id"), D.STAGES).alias("stage"), F.when(F.col("status") == "failed", F.col("created_us")).alias("invalidated_us"))


def correction_outcomes(spark, d):
    i = view(spark, d, "item")
    fields = F.filter(F.array(_pick(F.col("id"), ("decision", "products", "topics")), F.when(F.col("id") % 4 == 0, "importance_score"), F.when(F.col("id") % 9 == 0, "content_form")), lambda x: x.isNotNull())
    o = D.correction_outcome(_pick(F.col("id"), ("relevance", "message_analysis", "importance", "importance")), fields, F.col("importance_score"), F.lit(0.5))
    return i.select("id", o.alias("o")).select("id", F.array_join("o.unsupported", ",").alias("unsupported"), "o.final_score")


# ---- sources


def candidate_validation(spark, d):
    k = F.col("page_id")
    rows = _table(spark, d, "pages").select(
        "page_id", F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" title "), k.cast("string"))).alias("native_title"), F.when(k % 7 == 0, F.substring("url", 8, 200)).otherwise(F.col("url")).alias("canonical_url"),
        F.lit(" a ").alias("author_name"), F.lit("").alias("language"), k.cast("string").alias("external_id"), F.concat(F.lit("2024-01-01T00:00:00"), _pick(k, ("Z", "+08:00", ""))).alias("published_at"), (k % 11).alias("n_blocks"),
    )
    return D.validated_candidates(rows).select("page_id", "native_title", "canonical_url", "author_name", "language", F.coalesce("error", F.lit("")).alias("error"))


def platform_identities(spark, d):
    """Accounts named by urls: those of the pages, and the same paths on two platforms."""
    host = _pick(F.col("page_id"), ("https://www.X.com/", "https://twitter.com/", "http://weibo.com/u/", "https://weibo.com/", ""))
    url = F.when(host == "", F.col("url")).otherwise(F.concat(host, F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)))
    return _table(spark, d, "pages").select("page_id", D.platform_identity(url).alias("a")).select("page_id", "a.connector_type", "a.external_key")


def article_heads(spark, d):
    """Title, identity and language of article pages."""
    head = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return _table(spark, d, "pages").select("page_id", F.sha2(F.col("url"), 256).alias("external_id"), T.clean_text(head).alias("title"))


def list_entries(spark, d):
    """Links of a list page to its own host, each canonical URL once, in order."""
    links = _table(spark, d, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href")))
    rows = links.select("page_id", "pos", root.alias("root"), F.regexp_replace(full, "[?#].*$", "").alias("link")).where(F.col("link").startswith(F.concat("root", F.lit("/"))))
    return rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def preview_entries(spark, d):
    """Previews with two sections each, one named by its type and one by its label."""
    k = F.col("id")
    entry = lambda n: F.struct(F.concat(F.lit(" target "), (k % n).cast("string")).alias("target"), F.array(F.concat(F.lit(" +"), (k % 9).cast("string")), F.lit("  ")).alias("raw_changes"))
    section = lambda kind, label, *e: F.struct(kind.alias("section_type"), label.alias("label"), F.array(*e).alias("records"))
    sections = F.array(section(_pick(k, tuple(D.SECTIONS)), F.lit(None).cast("string"), entry(5), entry(3)), section(F.lit(""), _pick(k, ("Champion Buffs", "SYSTEM nerfs", "champion adjustments")), entry(7)))
    title = F.concat(_pick(k, ("\n Patch 14.", "Preview 1", " ")), (k % 30).cast("string"))
    docs = view(spark, d, "item").select("id", title.alias("title"), sections.alias("sections"))
    return D.preview_entries(docs).withColumn("changes", F.array_join("changes", "|"))


def report_due(spark, d):
    """The report day that is due at each event's time, with how many events say so."""
    day = daily.due_report_date(F.unix_micros(F.col("ts").cast("timestamp"))).cast("string")
    due = _table(spark, d, "events").groupBy(day.alias("report_date")).agg(F.count("*").alias("n"))
    return due.withColumn("scheduled_us", daily.scheduled_instant(F.col("report_date")))


def upsert_sources(spark, d):
    old = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("name"))
    new = _table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id"), F.lit("new").alias("name")).distinct()
    return ingest.upsert(old, new, "id")


def delete_keys(spark, d):
    left, gone = ingest.delete_keys(view(spark, d, "mention_all").select("id", "item_id"), view(spark, d, "item").where("status <> 'published'").select("id"), "item_id")
    return left.agg(F.count("*").alias("n")).select(F.lit("left").alias("what"), "n").unionByName(gone.select(F.lit("removed").alias("what"), "n"))


def featured_payloads(spark, d):
    p = D.featured_payload(view(spark, d, "item").withColumn("topics", F.array("topic")), "https://news.example.com")
    return p.withColumns({"products": F.array_join("products", ","), "topics": F.array_join("topics", ",")})


def recent_alerts(spark, d):
    e = _table(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.concat(F.lit("collection_failure:"), (F.col("user_id") % 20).cast("string"), F.lit(":network:"), F.col("event_id").cast("string")).alias("dedupe_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"), _pick(F.col("event_id"), ("pending", "sent", "dead", "failed")).alias("status"),
    )
    return D.recently_sent(e, "collection_failure:7:network:", known(spark, d)["latest_us"], 10 * 86_400).select("id", "status")


QUERIES = {
    "public_blocks": public_blocks,
    "scoped_rules": scoped_rules,
    "glossary_hits": glossary_hits,
    "source_options": source_options,
    "message_type_options": message_type_options,
    "projection_restore": projection_restore,
    "membership_totals": membership_totals,
    "decision_errors": decision_errors,
    "mention_order": lambda s, d: D.mention_groups_in_order(view(s, d, "mention_all")),
    "claimable_jobs": claimable_jobs,
    "stale_events": stale_events,
    "ttl_refresh": ttl_refresh,
    "next_stage": lambda s, d: D.next_stage(_checkpoints(s, d)),
    "restart_checkpoints": lambda s, d: D.restart_from(_checkpoints(s, d), "analysis"),
    "correction_outcomes": correction_outcomes,
    "candidate_validation": candidate_validation,
    "platform_identities": platform_identities,
    "article_heads": article_heads,
    "list_entries": list_entries,
    "preview_entries": preview_entries,
    "report_due": report_due,
    "upsert_sources": upsert_sources,
    "delete_keys": delete_keys,
    "featured_payloads": featured_payloads,
    "recent_alerts": recent_alerts,
}

_list = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" for x in xs) + "]"
_at = lambda x, xs: f"({_list(xs)})[({x}) % {len(xs)} + 1]"
_day = "((epoch_ms(0) + to_microseconds({}) + interval 8 hour)::date)"
CHECKPOINTS = f"cp as (select id, raw_item_id, {_at('o_custkey + id', D.STAGES)} stage, status = 'failed' bad from job)"
_kinds = ", ".join(f"('{k}', '{label}', '{target}')" for k, (label, target) in D.SECTIONS.items())
_terms = ", ".join(f"('{a}', '{b}')" for i, (a, b) in enumerate(TERMS) if i != 3)
SQL = {
    "public_blocks": q(
        f"""n as (select count(*) c from documents), a as (select event_id aid, event_id % c id, (event_id // c) % 4 pos, case when event_id % 5 = 0 then '/media/public/' || event_id end pub, {_at('event_id', ('/media/x/', '/media/private/', '/api/', '/media/w/'))} || event_id st from events, n),
        p as (select id, pos, arg_max(pub, aid) pub from a where pub is not null group by 1, 2), s as (select id, pos, arg_max(st, aid) st from a where pub is null and st like '/media/%' and st not like '%/private/%' group by 1, 2),
        b as (select item.id, v.* from item, (values (0, 'image', null), (1, 'paragraph', null), (2, 'image', '/media/c'), (3, 'image', null), (4, 'image', null)) v(pos, type, own))""",
        "select b.id, b.pos, b.type, case when type = 'image' then coalesce(pub, st, own) end storage_path from b left join p on p.id = b.id and p.pos = b.pos left join s on s.id = b.id and s.pos = b.pos",
    ),
    "scoped_rules": q(
        f"""ru as (select p_partkey id, case p_partkey % 3 when 0 then 'global' when 1 then 'connector:' || {_at('p_partkey // 3', V.CONNECTORS)} else 'source:' || (p_partkey // 3) % 20 end as scope, p_partkey % 4 as version, p_partkey * 7919 % 10007 u from part where p_partkey % 10 <> 0),
        h as (select src.id source_id, ru.id rule_id, '[' || scope || ' v' || version || '] rule ' || ru.id as text, row_number() over (partition by src.id order by u desc, ru.id desc) as position from src join ru on scope in ('global', 'connector:' || connector_type, 'source:' || src.id))""",
        "select * from h where position <= 100",
    ),
    "glossary_hits": q(f"t as (select * from (values {_terms}) v(term, translation))", "select id, term, translation from item join t on contains(lower(content), lower(term))"),
    "source_options": q("z as (select 1)", "select distinct s.id, s.name from src s join raw r on r.source_id = s.id where not exists (select 1 from raw n where n.supersedes = r.id)"),
    "message_type_options": q("z as (select 1)", "select distinct message_type as option from item where message_type <> '' union select 'null' from raw r where not exists (select 1 from raw n where n.supersedes = r.id) and r.id not in (select raw_item_id from item)"),
    "projection_restore": q(
        f"""rv as (select event_id, item_id, item_revision, mention_index, policy, 'title ' || id title, 'state ' || id % 7 s, {_at('id', ('confirmed', 'resolved', 'denied', None, 'developing'))} l from mention_all where id % 5 > 0),
        mt as (select event_id, item_id, item_revision, mention_index, policy, max(id) id, arg_max(time_us, id) t from mention where materiality = 'material_update' group by 1, 2, 3, 4, 5),
        w as (select m.event_id, r.title, r.s, r.l, row_number() over (partition by m.event_id order by m.t desc, m.id desc, r.title desc) n from mt m join rv r using (event_id, item_id, item_revision, mention_index, policy)),
        mat as (select event_id, bool_or(materiality = 'material_update') m from mention group by 1)""",
        "select st.id event_id, coalesce(w.title, st.title) title, coalesce(w.s, st.summary) current_summary, case when w.event_id is not null then coalesce(w.l, 'developing') when coalesce(mat.m, false) then 'developing' else 'stale' end lifecycle_status from story st left join w on w.event_id = st.id and w.n = 1 left join mat on mat.event_id = st.id",
    ),
    "membership_totals": q(
        """e as (select item_id, event_id k, relation r, count(*) n from mention_all group by all), p as (select item_id, case when id % 7 = 0 then event_id + 1 else event_id end k, relation r, count(*) n from mention_all where item_id % 17 <> 0 group by all),
        o as (select coalesce(e.item_id, p.item_id) item_id, sum(greatest(coalesce(e.n, 0) - coalesce(p.n, 0), 0)) missing, sum(greatest(coalesce(p.n, 0) - coalesce(e.n, 0), 0)) extra from e full join p on e.item_id = p.item_id and e.k = p.k and e.r = p.r group by 1)""",
        "select count(*) item_count, count(*) filter (missing + extra = 0) as exact, count(*) filter (missing + extra > 0) mismatch, sum(missing)::bigint missed_membership, sum(extra)::bigint extra_membership, count(*) filter (item_id % 17 = 0) missing_prediction from o",
    ),
    "decision_errors": q(
        f"""x as (select m.id, {_at('m.id', ('attach', 'create', 'ignore', 'merge', 'attach'))} a, case when m.id % 4 <> 0 then m.event_id end ev, case when m.id % 6 = 0 then 'tft' else i.product end p, i.products ps, {_at('m.id', ('esports_match', 'gameplay_balance', 'no_such_family'))} f, content_form = 'repost' rep from mention_all m join item i on i.id = m.item_id)""",
        """select id, case when a = 'merge' then 'unsupported action' when a = 'attach' and ev is null then 'attach needs an event' when a <> 'attach' and ev is not null then 'only attach names an event'
        when a <> 'ignore' and not list_contains(ps, p) then 'product is not the message''s' when a <> 'ignore' and f = 'no_such_family' then 'family is outside the space' when a = 'create' and rep then 'a repost creates no event' else '' end error from x""",
    ),
    "mention_order": q("g as (select item_id, item_revision, policy, list_sort(list(mention_index)) l from mention_all group by 1, 2, 3)", "select item_id, item_revision, policy, l = range(0, len(l)) in_order from g"),
    "claimable_jobs": q(
        "n as (select max(created_us) t from job), j as (select id, attempts, case when status = 'completed' and id % 3 = 0 then 'running' else status end status, case when id % 2 = 0 then created_us + attempts * 10000000000000 end due, case when id % 7 > 0 then created_us + 3000000000000 end lease from job)",
        "select id, status, attempts from j, n where attempts < 3 and (status = 'queued' or (status = 'failed' and due <= t) or (status = 'running' and (lease is null or lease <= t)))",
    ),
    "stale_events": q("z as (select 1)", "select id, last_seen_us calculated_us from story where last_seen_us is null or last_seen_us <= (select as_of from latest_us) - 86400000000 order by last_seen_us nulls first, id limit 100"),
    "ttl_refresh": q(HEAT, "select * from heat where event_id in (select id from story where last_seen_us is null or last_seen_us <= (select as_of from latest_us) - 86400000000 order by last_seen_us nulls first, id limit 100)"),
    "next_stage": q(
        f"{CHECKPOINTS}, d as (select raw_item_id, list_filter({_list(D.STAGES)}, lambda s: not list_contains(coalesce(ok, []), s)) left_ from (select raw_item_id, list(distinct stage) filter (not bad) ok from cp group by 1) x)",
        f"select raw_item_id, case when len(left_) = 0 then {len(D.STAGES)} else list_position({_list(D.STAGES)}, left_[1]) - 1 end done, left_[1] as next from d",
    ),
    "restart_checkpoints": q(CHECKPOINTS, "select raw_item_id, max(id) checkpoint_id from cp where stage = 'translation' and not bad group by 1"),
    "correction_outcomes": q(
        f"""x as (select id, importance_score s, {_at('id', ('relevance', 'message_analysis', 'importance', 'importance'))} st, list_filter([{_at('id', ('decision', 'products', 'topics'))}, case when id % 4 = 0 then 'importance_score' end, case when id % 9 = 0 then 'content_form' end], lambda f: f is not null) f from item),
        y as (select *, list_sort(list_filter(f, lambda v: not list_contains(case st when 'relevance' then ['decision'] when 'message_analysis' then ['products', 'content_form'] else ['message_type', 'topics', 'importance_score'] end, v))) bad from x)""",
        "select id, array_to_string(bad, ',') unsupported, case when len(bad) = 0 then (case when st = 'importance' and list_contains(f, 'importance_score') then 0.5 else s end) end final_score from y",
    ),
    "candidate_validation": r"""with p as (select page_id, case when page_id % 3 > 0 then 'title ' || page_id end native_title, nullif(trim(case when page_id % 7 = 0 then substr(url, 8, 200) else url end), '') canonical_url, page_id % 3 z from pages)
        select page_id, native_title, canonical_url, 'a' author_name, null::varchar as language, case when page_id % 11 <= 0 then 'no content blocks' when not regexp_matches(canonical_url, '^(?i:https?)://[^/?#]') then 'url must be absolute' when z = 2 then 'time needs a zone' else '' end error from p""",
    "platform_identities": r"""with u as (select page_id, page_id % 5 k, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) rest from pages), s as (select page_id, k, list_filter(string_split(case k when 2 then 'u/' || regexp_extract(rest, '^([^?#]*)', 1) else regexp_extract(rest, '^([^?#]*)', 1) end, '/'), lambda p: p <> '') parts from u)
        select page_id, case when k in (0, 1) and len(parts) > 0 then 'x_twitter' when k in (2, 3) and len(parts) > 0 then 'weibo' end connector_type, case when k in (0, 1) then parts[1] when k in (2, 3) then (case when parts[1] = 'u' and len(parts) > 1 then parts[2] else parts[1] end) end external_key from s""",
    "article_heads": r"""select page_id, sha256(url) external_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\f\v]+', ' ', 'g')) title from pages""",
    "list_entries": r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href, unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) pos from pages),
        f as (select page_id, pos, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) root, href from l), g as (select page_id, pos, root, regexp_replace(case when regexp_matches(href, '^https?://') then href when href like '/%' then root || href end, '[?#].*$', '') link from f)
        select page_id, link, min(pos) pos from g where starts_with(link, root || '/') group by 1, 2""",
    "preview_entries": q(
        f"""k as (select * from (values {_kinds}) v(kind, label, target_type)),
        x as (select id, trim(replace({_at('id', ('~ Patch 14.', 'Preview 1', ' '))}, '~', '') || id % 30) title from item),
        y as (select x.*, v.section, v.target, case v.section when 0 then {_at('x.id', tuple(D.SECTIONS))} else {_at('x.id', ('champion_buff', 'system_nerf', 'champion_adjustment'))} end kind from x, lateral (values (0, 'target ' || x.id % 5), (0, 'target ' || x.id % 3), (1, 'target ' || x.id % 7)) v(section, target))""",
        r"select id, nullif(regexp_extract(title, '\b(\d{1,2}\.\d{1,2})\b', 1), '') patch, title, section, kind section_type, label, target, target_type, '+' || id % 9 changes from y join k using (kind)",
    ),
    "report_due": f"select d::date::varchar report_date, count(*) n, epoch_us(((d + 1)::date)::timestamp) - 28800000000 scheduled_us from (select ({_day.format('epoch_us(ts)')} - 1)::date d from events) group by d",
    "upsert_sources": "select o_custkey * 2 id, 'new' as name from orders group by 1 union all select c_custkey, 'old' from customer where c_custkey not in (select o_custkey * 2 from orders)",
    "delete_keys": q("g as (select count(*) filter (i.status = 'published' or i.id is null) l, count(*) filter (i.status <> 'published') r from mention_all m left join item i on i.id = m.item_id)", "select 'left' what, l n from g union all select 'removed', r from g"),
    "featured_payloads": q(
        "z as (select 1)",
        """select id normalized_item_id, case when t = '' then '-' when length(t) > 300 then t[1:300] || '…' else t end title, case when summary = '' then '-' else summary end summary, source_name, connector_type, array_to_string(products[1:3], ',') products, message_type,
        round(importance_score, 4) importance_score, seen_us published_us, author author_name, topic topics, 'https://news.example.com/messages/' || id url from (select *, trim(coalesce(translated_title, title)) t from item) where status = 'published' and importance_score >= 0.75 and content_form <> 'repost'""",
    ),
    "recent_alerts": q("z as (select 1)", f"select event_id id, {_at('event_id', ('pending', 'sent', 'dead', 'failed'))} status from events where event_type = 'error' and user_id % 20 = 7 and epoch_us(ts) >= (select as_of from latest_us) - 864000000000 and event_id % 4 <> 2"),
}
