"""Queries over messages: scoring, validity, routing, search, reports; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import text as T
from pressline.functions import vocab as V
from pressline.operators import daily, messages, reviews, search
from pressline.plans.events import _mentions
from pressline.plans.sql_events import level, q
from pressline.sources.adapter import view


def _items(spark, d):
    return view(spark, d, "item").withColumn("topics", F.array("topic"))


def importance_profile(spark, d):
    return messages.importance_profile(_items(spark, d)).select("id", "profile")


def message_importance(spark, d):
    return messages.message_importance(_items(spark, d)).select("id", "profile", "modifier_total", "profile_score", "importance")


def message_priority(spark, d):
    return _items(spark, d).select("id", messages.priority(F.col("importance_score"), F.col("content_form"), F.col("audience_region")).alias("priority"))


def _side():
    return F.element_at(F.array(*map(F.lit, V.SOURCE_KINDS)), (F.col("id") % 3 + 1).cast("int"))


def classification_errors(spark, d):
    """Item labels, some of them broken on purpose."""
    i = _items(spark, d)
    products = F.when(F.col("id") % 31 == 0, F.array(F.lit("unknown"), F.col("product"))).when(F.col("id") % 37 == 0, F.array("product", "product")).otherwise(F.col("products"))
    topics = F.when(F.col("id") % 41 == 0, F.array(F.col("topic"), F.lit("unknown"))).when(F.col("id") % 43 == 0, F.array(F.lit("champions"))).otherwise(F.col("topics"))
    error = messages.classification_error(products, F.col("content_form"), F.col("message_type"), topics, _side())
    return i.select("id", F.coalesce(error, F.lit("")).alias("error"))


def classification_catalogue(spark, d):
    """Legal types and topics of each product on each side that messages of it come from."""
    rows = view(spark, d, "item").select("product", _side().alias("source_kind")).distinct()
    legal = rows.select("product", "source_kind", reviews.legal_labels(F.array("product"), F.col("source_kind")).alias("l"))
    coded = lambda kind, codes: F.transform(codes, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code")))
    return legal.select("product", "source_kind", F.explode(F.concat(coded("type", F.col("l.types")), coded("topic", F.col("l.topics")))).alias("x")).select("product", "source_kind", "x.kind", "x.code")


def event_family_routing(spark, d):
    return _items(spark, d).select("id", F.array_join(messages.event_families(F.col("products"), F.col("topics")), ",").alias("families"))


def event_admission(spark, d):
    e = messages.event_admission(F.col("status"), F.col("content_form"), F.col("title"), F.col("content"))
    return _items(spark, d).select("id", e.alias("e")).select("id", "e.decision", "e.reason")


def _page(sort_by, **filters):
    def run(spark, d):
        rows, _ = search.search_published(_items(spark, d), sort_by=sort_by, limit=100, **filters)
        return rows.select("id", "seen_us", "importance_score", "priority_score")

    return run


def published_total(spark, d):
    return search.search_published(_items(spark, d), query="patch")[1]


def published_days(spark, d):
    return search.published_days(_items(spark, d)).select(F.col("day").cast("string").alias("day"), "n", "latest_us")


def _events(sort_by="time", **filters):
    def run(spark, d):
        rows, _ = search.search_events(view(spark, d, "story"), _mentions(spark, d), sort_by=sort_by, limit=100, **filters)
        return rows.select("id", "category", "importance_level", "heat_level", "time_us")

    return run


def event_categories(spark, d):
    v = search.event_view(view(spark, d, "story"))
    return v.groupBy("category", "importance_level").agg(F.count("*").alias("n"), F.max("time_us").alias("latest_us"))


def daily_report(spark, d):
    return daily.daily_report(_items(spark, d), _mentions(spark, d)).withColumn("report_date", F.col("report_date").cast("string"))


def daily_report_counts(spark, d):
    return daily.report_counts(daily.daily_report(_items(spark, d), _mentions(spark, d))).withColumn("report_date", F.col("report_date").cast("string"))


def eligible_days(spark, d):
    return daily.eligible_days(_items(spark, d)).withColumn("report_date", F.col("report_date").cast("string"))


def _admin(spark, d):
    return search.admin_status(view(spark, d, "raw"), view(spark, d, "item"), view(spark, d, "job"), view(spark, d, "run"))


def display_titles(spark, d):
    return _items(spark, d).select("id", T.display_title(F.col("title"), F.col("author"), F.col("content")).alias("display_title"))


def language_detect(spark, d):
    return _items(spark, d).select("id", T.detect_language(F.col("content")).alias("language"))


def evidence_gate(spark, d):
    title, text = F.col("title"), F.col("content")
    n = T.meaningful_chars(F.concat_ws("\n", title, text))
    return _items(spark, d).select("id", n.alias("n"), T.evidence_gate(title, text, F.col("id") % 12 == 0).alias("decision"))


QUERIES = {
    "importance_profile": importance_profile,
    "message_importance": message_importance,
    "message_priority": message_priority,
    "classification_errors": classification_errors,
    "classification_catalog": classification_catalogue,
    "event_family_routing": event_family_routing,
    "event_admission": event_admission,
    "published_search_time": _page("time"),
    "published_search_importance": _page("importance"),
    "published_search_priority": _page("priority", query="patch"),
    "published_featured": _page("importance", featured=True),
    "published_by_product": _page("time", product="tft"),
    "published_by_topic": _page("time", topic="cosmetics"),
    "published_by_id": _page("time", query="42"),
    "published_on_day": _page("time", day="2024-01-10"),
    "published_total": published_total,
    "published_days": published_days,
    "event_search_time": _events(),
    "event_search_heat": _events("heat", category="esports"),
    "event_search_importance": _events("importance", importance_level="high"),
    "event_search_level": _events(heat_level="hot"),
    "event_search_family": _events(event_family="media_release"),
    "event_search_text": _events(query="Summary of 1"),
    "event_search_lifecycle": _events(lifecycle="denied", credibility_level="plausible"),
    "event_categories": event_categories,
    "event_message_counts": lambda s, d: search.event_message_counts(_mentions(s, d)),
    "event_associations": lambda s, d: search.event_associations(_mentions(s, d), view(s, d, "story")),
    "event_timeline": lambda s, d: search.event_timeline(_mentions(s, d)),
    "daily_report": daily_report,
    "daily_report_counts": daily_report_counts,
    "eligible_days": eligible_days,
    "latest_raw_items": lambda s, d: search.latest_raw(view(s, d, "raw")).select("id", "source_id", "ingested_us"),
    "pending_raw_items": lambda s, d: search.pending_raw(view(s, d, "raw"), view(s, d, "item"), view(s, d, "run")).select("id"),
    "admin_status_page": lambda s, d: search.page(_admin(s, d).withColumn("seen_us", F.coalesce("published_us", "ingested_us")), ["seen_us", "id"], limit=100).select("id", "process_status", "seen_us"),
    "admin_status_counts": lambda s, d: search.status_counts(_admin(s, d)),
    "display_titles": display_titles,
    "language_detect": language_detect,
    "evidence_gate": evidence_gate,
}

# ---- DuckDB -------------------------------------------------------------------------

_family = "case topic " + " ".join(f"when '{t}' then '{f}'" for t, _, f in V.TOPICS) + " end"


def _routes() -> str:
    out = []
    for t, routes in V.PROFILE_ROUTES.items():
        for names, profile in routes:
            cond = f"message_type = '{t}'" + ("" if names == V.ANY else " and fam in (" + ", ".join(f"'{n}'" for n in names) + ")")
            out.append(f"when {cond} then '{profile}'")
    return " ".join(out)


def _says(pattern: str) -> str:
    return "regexp_matches(content, '(?i)" + pattern.replace("'", "''") + "')"


M = messages
_fin, _play = _says(M.FINAL), _says(M.PLAYOFF)
PROFILE = f"""
p1 as (select *, {_family} fam from item),
prof as (select *, case when message_type = 'game_notice' and {_says(M.HOTFIX)} then 'patch_hotfix' when message_type = 'game_official_preview' and {_says(M.FULL_PREVIEW)} then 'patch_full_preview'
  when message_type = 'game_announcement' and fam = 'gameplay' and {_says(M.WEEKLY_FREE)} then 'weekly_free_champion_rotation'
  when message_type = 'game_community_notice' and fam = 'commerce' then (case when {_says(M.RARE_COSMETIC)} then 'shop_rare_cosmetic' when {_says(M.BULK_REFRESH)} then 'shop_bulk_refresh' when {_says(M.COSMETIC)} then 'shop_cosmetic_rotation' else 'shop_daily_standard' end)
  when message_type = 'game_community_notice' and fam = 'activity' and {_says(M.FREE_SKIN)} and not {_says(M.LOTTERY)} then 'activity_free_skin'
  when message_type = 'esports_announcement' and fam = 'esports_matches' then (case when {_says(M.WORLD_EVENT)} then (case when {_fin} or {_play} then 'worlds_key' else 'worlds_regular' end) when {_fin} then 'esports_final' when {_play} then 'esports_playoffs' else 'esports_regular' end)
  {_routes()} end profile from p1),
band as (select * from (values {", ".join(f"('{p}', {b}::double, {f}::double, {c}::double)" for p, (b, f, c) in V.SCORE_BANDS.items())}) v(profile, base, floor, cap)),
mods as (select p.*, b.base, b.floor, b.cap, (case scale when 'minor' then (case when profile in ('patch_hotfix', 'service_notice', 'security_notice') then -0.07 else -0.03 end)
     when 'major' then (case when profile in ('patch_hotfix', 'service_notice', 'security_notice') then 0.09 else 0.03 end) else 0 end)::double
   + (case when is_bulk_update and profile not in ('shop_bulk_refresh', 'patch_full_preview', 'patch_official_notes', 'weekly_free_champion_rotation') then 0.03 else 0 end)::double
   + (case when profile like 'esports\\_%' escape '\\' or profile like 'worlds\\_%' escape '\\' then (case competition_region when 'lpl' then 0.03 when 'lck' then 0 when 'international' then 0.01 else -0.03 end) else 0 end)::double
   + (case when profile in ('esports_regular', 'esports_playoffs', 'esports_final', 'worlds_regular', 'worlds_key', 'roster_announcement', 'esports_rumor') then (case prominence when 'notable' then 0.03 when 'star' then 0.07 else 0 end) else 0 end)::double
   + (case when profile in ('cosmetic_announcement', 'promotion_cosmetic') and not (skin_tier = 'prestige_or_mythic' and {_says(M.PAID_CHROMA)} and not {_says(M.EXPLICIT_PRESTIGE)})
       then (case skin_tier when 'legendary' then 0.04 when 'prestige_or_mythic' then 0.06 when 'ultimate' then 0.10 else 0 end) else 0 end)::double total from prof p join band b using (profile)),
scored as (select id, profile, content_form, round(total, 4) modifier_total, round(least(cap, greatest(floor, base + total)), 4) profile_score from mods)"""

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_types = ", ".join(f"('{t}', {_list(ps)}, '{s}')" for t, ps, s in V.MESSAGE_TYPES)
_topics = ", ".join(f"('{t}', {_list(ps)}, {i})" for i, (t, ps, _) in enumerate(V.TOPICS))
E = {k: f"'{v}'" for k, v in M.ERRORS.items()}
CLASSIFY = f"""
mt as (select * from (values {_types}) v(code, ps, side)), tp as (select * from (values {_topics}) v(code, ps, ord)),
c1 as (select id, content_form, message_type, case id % 3 when 0 then 'official' when 1 then 'unofficial' else 'unknown' end kind,
  case when id % 31 = 0 then ['unknown', product] when id % 37 = 0 then [product, product] else products end pr, case when id % 41 = 0 then [topic, 'unknown'] when id % 43 = 0 then ['champions'] else [topic] end tps from item),
c2 as (select c.*, (select list_filter({_list(V.PRODUCTS)}, lambda x: list_contains(c.pr, x))) po, (select list_filter({_list(V.TOPIC_ORDER)}, lambda x: list_contains(c.tps, x))) tor, mt.ps mps, mt.side,
  (select min_by(t.code, list_position(c.tps, t.code)) from tp t where t.code <> 'unknown' and list_contains(c.tps, t.code) and not list_has_any(t.ps, c.pr)) stray from c1 c left join mt on mt.code = c.message_type),
cls as (select id, coalesce(case when len(pr) > 3 or len(list_distinct(pr)) < len(pr) then {E['product_count']} when po <> pr then {E['product_order']} when list_contains(pr, 'unknown') and len(pr) > 1 then {E['product_unknown']}
  when content_form in ('media_only', 'link_only') and pr <> ['unknown'] then {E['form_products']} when len(list_distinct(tps)) < len(tps) then {E['topic_count']} when tor <> tps then {E['topic_order']} when list_contains(tps, 'unknown') and len(tps) > 1 then {E['topic_unknown']}
  when content_form in ('media_only', 'link_only') then (case when message_type <> 'unknown' or tps <> ['unknown'] then {E['form_type']} end)
  when message_type <> 'unknown' and not list_has_any(mps, pr) then {E['type_product']} when message_type <> 'unknown' and kind <> 'unknown' and side not in ('any', kind) then {E['type_source']}
  when stray is not null then replace({E['topic_product']}, '{{}}', stray) end, '') error from c2)"""
_pf = ", ".join(f"('{p}', '{f}', {V.EVENT_FAMILIES.index(f)})" for p, fs in V.PRODUCT_EVENT_FAMILIES.items() for f in fs)
_tf = ", ".join(f"('{t}', '{f}')" for t, fs in V.TOPIC_EVENT_FAMILIES.items() for f in fs)
ROUTING = f"""
pf as (select * from (values {_pf}) v(p, f, o)), tf as (select * from (values {_tf}) v(t, f)),
al as (select distinct i.id, pf.f, pf.o, exists (select 1 from tf where tf.t = i.topic and tf.f = pf.f) routed from item i join pf on list_contains(i.products, pf.p)),
fam as (select i.id, coalesce((select string_agg(f, ',' order by o) from al where al.id = i.id and routed), (select string_agg(f, ',' order by o) from al where al.id = i.id), 'other_named_development') families from item i)"""
_cat = "case when event_family in ({}) or product = 'lol_esports' then 'esports' when event_family in ({}) or product in ('riot_ecosystem', 'lol_universe') then 'ecosystem' when product = 'lol_pc' then 'lol_pc' when product = 'tft' then 'tft' else 'other_products' end".format(
    ", ".join(f"'{f}'" for f in V.ESPORTS_FAMILIES), ", ".join(f"'{f}'" for f in V.ECOSYSTEM_FAMILIES)
)
EV = f"""ev as (select *, {_cat} category, {level('importance_score', V.IMPORTANCE_LEVELS)} importance_level, {level('heat_score', V.HEAT_LEVELS)} heat_level, coalesce(last_material_us, last_seen_us, created_us) time_us
   from story where id in (select event_id from mention))"""
_day = "((epoch_ms(0) + to_microseconds({}) + interval 8 hour)::date)"
REPORT = f"""
elig as (select id, {_day.format('published_us')} report_date, importance_score score, published_us, product, product2 from item where status = 'published' and content_form = 'original' and importance_score >= 0.60 and published_us is not null),
el2 as (select *, row_number() over (partition by report_date order by score desc, published_us desc, id desc) rn, coalesce((select list(distinct event_id) from mention m where m.item_id = elig.id), []::bigint[]) evs from elig),
rec as (with recursive walk as (
   select report_date, 0::bigint rn, []::bigint[] seen, null::bigint id from (select distinct report_date from el2)
   union all
   select e.report_date, e.rn, case when list_has_any(w.seen, e.evs) then w.seen else list_distinct(list_concat(w.seen, e.evs)) end, case when list_has_any(w.seen, e.evs) then null else e.id end
   from walk w join el2 e on e.report_date = w.report_date and e.rn = w.rn + 1) select * from walk),
kept as (select r.report_date, r.rn, r.id, case when 'lol_esports' in (e.product, e.product2) then 'esports' when 'lol_pc' in (e.product, coalesce(e.product2, '')) then 'lolpc' when 'tft' in (e.product, coalesce(e.product2, '')) then 'tft' else 'other' end section from rec r join el2 e on e.id = r.id where r.id is not null),
rank0 as (select *, row_number() over (partition by report_date, section order by rn) position from kept),
report as (select report_date::varchar report_date, section, position, id from rank0 where position <= (case section when 'lolpc' then 5 else 3 end))"""
REPORT = REPORT.replace("'lol_esports' in (e.product, e.product2)", "'lol_esports' in (e.product, coalesce(e.product2, ''))")
LATEST = "lat as (select * from raw where id not in (select supersedes from raw where supersedes is not null))"
ADMIN = f"""{LATEST},
jl as (select raw_item_id, arg_max(status, id) job, arg_max(attempts, id) < 3 retry from job group by 1), rl as (select raw_item_id, arg_max(status, id) run from run group by 1),
a1 as (select l.*, i.status pub, j.job, j.retry, r.run, coalesce(job in ('queued', 'running') or (job = 'failed' and retry), false) active from lat l left join item i on i.id = l.id left join jl j on j.raw_item_id = l.id left join rl r on r.raw_item_id = l.id),
a2 as (select *, coalesce(job = 'failed' and not retry, false) or (not active and coalesce(run = 'failed', false)) failed, active or coalesce(run in ('running', 'awaiting_review'), false) proc,
   coalesce(pub = 'published', false) or coalesce(job = 'completed', false) or coalesce(run = 'completed', false) done from a1),
adm as (select id, coalesce(published_us, ingested_us) seen_us, case when failed then 'failed' when proc then 'processing' when done then 'completed' else 'pending' end process_status from a2)"""


def _psql(where: str, order: str) -> str:
    return q("z as (select 1)", f"select id, seen_us, importance_score, priority_score from item where status = 'published' and {where} order by {order} desc nulls first, id desc limit 100")


def _esql(where: str, order: str = "time_us") -> str:
    return q(EV, f"select id, category, importance_level, heat_level, time_us from ev where {where} order by {order} desc nulls first, time_us desc nulls first, id desc limit 100")


SQL = {
    "importance_profile": q(PROFILE, "select id, profile from prof"),
    "message_importance": q(PROFILE, "select id, profile, modifier_total, profile_score, round(greatest(0, least(1, profile_score + case when content_form = 'repost' then -0.08 else 0 end)), 4) importance from scored"),
    "message_priority": q("z as (select 1)", "select id, round(greatest(0, least(1, importance_score + (case when content_form = 'quote' then -0.02 else 0 end)::double + (case when audience_region = 'international_only' then -0.12 else 0 end)::double)), 4) priority from item"),
    "classification_errors": q(CLASSIFY, "select * from cls"),
    "classification_catalog": q(
        f"mt as (select * from (values {_types}) v(code, ps, side)), tp as (select * from (values {_topics}) v(code, ps, ord)), pk as (select distinct product, ({_list(V.SOURCE_KINDS)})[id % 3 + 1] source_kind from item)",
        """select product, source_kind, 'type' kind, code from pk, mt where code = 'unknown' or (list_contains(ps, product) and (source_kind = 'unknown' or side in ('any', source_kind)))
      union all select product, source_kind, 'topic', code from pk, tp where code = 'unknown' or list_contains(ps, product)""",
    ),
    "event_family_routing": q(ROUTING, "select * from fam"),
    "event_admission": q("r as (select id, case when status <> 'published' then 'normalized item is not published' when content_form in ('media_only', 'link_only') or (trim(title) = '' and trim(content) = '') then 'normalized item has no semantic text' else 'semantic published message' end reason from item)", "select id, case when reason like 'semantic%' then 'process' else 'skip' end decision, reason from r"),
    "published_search_time": _psql("true", "seen_us"),
    "published_search_importance": _psql("true", "importance_score"),
    "published_search_priority": _psql("concat_ws(chr(1), title, translated_title, summary, content, translated_text, author, source_name) ilike '%patch%'", "priority_score"),
    "published_featured": _psql("importance_score >= 0.75 and content_form <> 'repost'", "importance_score"),
    "published_by_product": _psql("list_contains(products, 'tft')", "seen_us"),
    "published_by_topic": _psql("topic = 'cosmetics'", "seen_us"),
    "published_by_id": _psql("id = 42", "seen_us"),
    "published_on_day": _psql(f"{_day.format('seen_us')} = date '2024-01-10'", "seen_us"),
    "published_total": q("z as (select 1)", "select count(*) total from item where status = 'published' and concat_ws(chr(1), title, translated_title, summary, content, translated_text, author, source_name) ilike '%patch%'"),
    "published_days": q("z as (select 1)", f"select {_day.format('seen_us')}::varchar as day, count(*) n, max(seen_us) latest_us from item where status = 'published' group by 1 order by 1 desc limit 30"),
    "event_search_time": _esql("true"),
    "event_search_heat": _esql("category = 'esports'", "heat_score"),
    "event_search_importance": _esql("importance_level = 'high'", "importance_score"),
    "event_search_level": _esql("heat_level = 'hot'"),
    "event_search_family": _esql("event_family = 'media_release'"),
    "event_search_text": _esql("(title ilike '%summary of 1%' or summary ilike '%summary of 1%')"),
    "event_search_lifecycle": _esql("lifecycle = 'denied' and credibility_level = 'plausible'"),
    "event_categories": q(EV.replace(" where id in (select event_id from mention)", ""), "select category, importance_level, count(*) n, max(time_us) latest_us from ev group by 1, 2"),
    "event_message_counts": q("z as (select 1)", "select event_id, count(distinct item_id) messages, count(distinct source_id) sources from mention group by 1"),
    "event_associations": q(EV, "select distinct m.item_id, m.event_id, e.title, e.event_family, e.lifecycle, e.credibility_level, e.heat_level from mention m join ev e on e.id = m.event_id"),
    "event_timeline": q("z as (select 1)", "select event_id, row_number() over (partition by event_id order by time_us, id) as position, item_id, relation, materiality, time_us from mention"),
    "daily_report": q(REPORT, "select * from report"),
    "daily_report_counts": q(REPORT, "select report_date, count(*) filter (section = 'lolpc') lolpc, count(*) filter (section = 'esports') esports, count(*) filter (section = 'tft') tft, count(*) filter (section = 'other') other from report group by 1"),
    "eligible_days": q(REPORT, "select report_date::varchar report_date, count(*) n from elig group by 1"),
    "latest_raw_items": q(LATEST, "select id, source_id, ingested_us from lat"),
    "pending_raw_items": q(LATEST, "select id from lat where id not in (select raw_item_id from item) and id not in (select raw_item_id from run)"),
    "admin_status_page": q(ADMIN, "select id, process_status, seen_us from adm order by seen_us desc nulls first, id desc limit 100"),
    "admin_status_counts": q(ADMIN, "select count(*) as \"all\", count(*) filter (process_status = 'failed') failed, count(*) filter (process_status = 'processing') processing, count(*) filter (process_status = 'completed') completed, count(*) filter (process_status = 'pending') pending from adm"),
    "display_titles": q(
        r"t1 as (select id, trim(title) own, trim(author) nm, coalesce(list_filter(list_transform(regexp_split_to_array(content, '\r\n|[\n\r]'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '')[1], '') ln from item), t2 as (select id, case when own <> '' then own when nm <> '' and ln <> '' then nm || '：' || ln else nm || ln end v from t1)",
        "select id, case when v = '' then null when length(v) <= 500 then v else rtrim(v[1:499]) || '…' end display_title from t2",
    ),
    "language_detect": q(r"l as (select id, length(regexp_replace(content, '\s', '', 'g')) vis, length(regexp_replace(content, '[^一-鿿]', '', 'g')) han from item)", "select id, case when vis = 0 then 'unknown' when han / vis >= 0.1 then 'zh-CN' else 'en' end as language from l"),
    "evidence_gate": q("g as (select id, length(regexp_replace(title || chr(10) || content, '[^A-Za-z0-9一-鿿]', '', 'g')) n from item)", "select id, n, case when n < 12 and id % 12 <> 0 then 'insufficient_evidence' else 'process' end decision from g"),
}
