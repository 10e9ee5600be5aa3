"""The news model over the driver's tables.

Every view is written once, in SQL that Spark and DuckDB both run, so that the
engine and its oracle see the same rows. Times are microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pressline.functions import vocab as V

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
HOUR = 3_600_000_000
PHRASES = (
    "", "hotfix for the client", "full preview of the patch", "worlds finals tonight", "playoffs start", "free skin for everyone", "weekly free champions",
    "limited chroma in the shop", "multiple items refresh", "server-side update", "semifinals recap", "skin lottery 抽奖",
)


class Dialect:
    """How an engine writes what the views need. ``known`` holds counts and the latest
    time as literals, so that Spark need not scan tables for them again in every view."""

    def __init__(self, spark: bool, known: dict[str, int] | None = None):
        self.spark, self.known = spark, known or {}

    def scalar(self, name: str, sql: str) -> str:
        return str(self.known[name]) if name in self.known else f"({sql})"

    def us(self, x: str) -> str:
        return f"unix_micros(cast({x} as timestamp))" if self.spark else f"epoch_us({x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def pick(self, x: str, values) -> str:
        """The value at position x (0-based) of a fixed list."""
        return f"(case {x} " + " ".join(f"when {i} then {v!r}" for i, v in enumerate(values)) + " end)"


def _values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) as v({columns}))"


def views(d: Dialect) -> dict[str, str]:
    types = [(p, i, len(V.legal_types(p)), t) for p in V.PRODUCTS for i, t in enumerate(V.legal_types(p))]
    topics = [(p, i, len(V.legal_topics(p)), t) for p in V.PRODUCTS for i, t in enumerate(V.legal_topics(p))]
    doc_count, event_count = d.scalar("documents", "select count(*) from documents"), d.scalar("events", "select count(*) from events")
    latest = d.scalar("latest_us", f"select max({d.us('ts')}) from events")
    return {
        "ptype": _values(types, "product, ord, n, code"),
        "ptopic": _values(topics, "product, ord, n, code"),
        "src": f"""(select id, 'source ' || id as name, {d.pick('id % 6', V.CONNECTORS)} as connector_type, 'key' || id as external_key,
            id % 6 in (0, 3) as is_official, id / 20e0 as reliability from (select distinct doc_id % 20 as id from documents) s)""",
        "raw": f"""(select d.doc_id as id, d.doc_id % 20 as source_id, 'x' || (d.doc_id % 700) as external_id, d.text, d.lang,
            case when d.doc_id % 100 >= 80 then d.doc_id - 20 end as supersedes, case when d.doc_id % 17 = 0 then null else {d.us('e.ts')} end as published_us,
            {d.us('e.ts')} as ingested_us, 'author ' || e.user_id as author
            from (select *, (doc_id * 10 + 9) % {event_count} as ev from documents) d join events e on e.event_id = d.ev)""",
        "succ": "(select distinct doc_id - 20 as id from documents where doc_id % 100 >= 80)",
        "item0": f"""(select r.*, s.id is not null as replaced, {d.pick('r.id % 7', V.PRODUCTS)} as product,
            case when r.id % 4 = 0 and r.id % 7 < 5 then {d.pick('r.id % 7', V.PRODUCTS[1:6])} end as product2,
            {d.pick('r.id % 12', PHRASES)} || ' ' || coalesce(r.text, '') as content
            from raw r left join succ s on s.id = r.id)""",
        "item": f"""(select i.id, i.id as raw_item_id, i.source_id, i.published_us, i.ingested_us, coalesce(i.published_us, i.ingested_us) as seen_us, i.content, i.author, i.lang,
            case when i.replaced then 'superseded' when i.id % 23 = 0 then 'withdrawn' else 'published' end as status,
            case i.id % 10 when 7 then 'repost' when 8 then 'quote' when 9 then 'media_only' else 'original' end as content_form,
            t.code as message_type, i.product, i.product2, p.code as topic,
            case when i.product2 is null then {d.array('i.product')} else {d.array('i.product', 'i.product2')} end as products,
            {d.pick('i.id % 3', ('minor', 'standard', 'major'))} as scale, {d.pick('i.id % 5', ('lpl', 'lck', 'international', 'other', 'none'))} as competition_region,
            {d.pick('i.id % 3', ('star', 'normal', 'notable'))} as prominence, {d.pick('i.id % 5', ('none', 'standard', 'legendary', 'prestige_or_mythic', 'ultimate'))} as skin_tier,
            i.id % 9 = 0 as is_bulk_update, {d.pick('i.id % 6', ('international_only', 'cn', 'global', 'cn', 'unknown', 'global'))} as audience_region,
            (i.id * 37 % 101) / 100e0 as importance_score, (i.id * 53 % 97) / 97e0 as priority_score, 1 as current_revision,
            {d.pick('i.id % 7', ('patch_hotfix', 'esports_final', 'no_such_profile', 'riot_leak', 'media_release', 'unknown', 'leak_general'))} as importance_profile,
            case when i.id % 5 = 0 then 'title ' || i.id else '' end as title, case when i.id % 3 = 0 then '' else 'summary of ' || p.code || ' ' || (i.id % 60) end as summary,
            case when i.id % 9 = 4 then 'patch title ' || i.id end as translated_title, case when i.id % 9 = 5 then 'translated patch ' || i.id end as translated_text,
            'source ' || i.source_id as source_name, {d.pick('i.source_id % 6', V.CONNECTORS)} as connector_type
            from item0 i join ptype t on t.product = i.product and t.ord = i.id % t.n join ptopic p on p.product = i.product and p.ord = (i.id * 3) % p.n)""",
        "latest_us": f"(select {latest} as as_of)",
        "ment0": f"""(select e.event_id as id, e.event_id % {doc_count} as item_id, e.user_id as story, e.event_id as k, {d.us('e.ts')} as ts_us, e.event_type, e.props, e.user_id from events e
            union all select n * 10000000000 + r.id, r.id, case n when 1 then 100000 + r.id % 3 else 200000 end, case n when 1 then r.id else r.id * 4 end, r.ingested_us, case n when 1 then 'signup' else 'view' end, null, r.id
            from raw r cross join {_values([(1,), (2,)], 'n')} twice where r.ingested_us >= {latest} - {24 * HOUR})""",
        "mention_all": f"""(select m.id, m.story as event_id, m.item_id, 1 + (case when m.k % 29 = 28 then 1 else 0 end) as item_revision, m.k % 3 as mention_index, 'v1' as policy,
            case m.event_type when 'signup' then 'reports' when 'purchase' then 'confirms' when 'view' then 'supports' when 'click' then 'mentions'
                 else (case when m.user_id % 3 = 0 then 'denies' else 'corrects' end) end as relation,
            case when m.k % 8 < 2 and m.user_id % 5 <> 0 then 'independent_media' when m.user_id % 5 = 4 then 'unknown' else {d.pick('m.k % 8', tuple(V.SOURCE_ROLES))} end as source_role,
            {d.pick('m.k % 4', V.MATERIALITIES)} as materiality, case when m.k % 11 = 0 then null else 'g' || (m.item_id % 20) end as independence_group,
            case when m.k % 13 = 0 then null else m.props end as fingerprint, (m.item_id % 20) / 20e0 as reliability,
            case when m.k % 19 = 0 then null else m.ts_us end as snapshot_us, m.ts_us as added_us from ment0 m)""",
        "mention": """(select m.*, i.source_id, i.content_form, i.importance_score, i.importance_profile, i.published_us, i.ingested_us, i.seen_us,
            coalesce(m.snapshot_us, i.published_us, i.ingested_us, m.added_us) as time_us, i.id % 6 = 2 as has_media
            from mention_all m join item i on i.id = m.item_id and i.status = 'published' and i.current_revision = m.item_revision)""",
        "story": f"""(select user_id as id, 'story ' || user_id as title, 'summary of ' || (user_id * 7 % 100) as summary, {d.pick('user_id % 16', V.EVENT_FAMILIES)} as event_family,
            {d.pick('user_id % 6', V.PRODUCTS[:6])} as product,
            case when user_id % 11 = 10 then {d.array("'tft'", "'lol_pc'")} when user_id % 13 = 12 then {d.array("'unknown'")} else {d.array(d.pick('user_id % 6', V.PRODUCTS[:6]))} end as products, {d.pick('user_id % 7', V.LIFECYCLES)} as lifecycle, (user_id * 29 % 101) / 100e0 as importance_score,
            (user_id * 31 % 103) / 103e0 as heat_score, {d.pick('user_id % 6', V.CREDIBILITY_LEVELS)} as credibility_level,
            min({d.us('ts')}) as created_us, case when user_id % 3 = 0 then null else max({d.us('ts')}) end as last_seen_us,
            case when user_id % 2 = 0 then null else max({d.us('ts')}) - {HOUR} end as last_material_us from events group by user_id)""",
        "job": f"""(select o_orderkey as id, o_orderkey % {doc_count} as raw_item_id, case o_orderstatus when 'O' then 'queued' when 'F' then 'completed' else 'failed' end as status,
            {d.pick('o_orderkey % 5', ('relevance', 'translation', 'analysis', 'importance', 'publish'))} as stage, o_orderkey % 4 as attempts, o_orderkey % 3 as recovery_count,
            {d.us('o_orderdate')} as created_us, o_custkey from orders)""",
        "run": f"""(select l_orderkey * 8 + l_linenumber as id, l_partkey % {doc_count} as raw_item_id,
            case l_linestatus when 'O' then 'running' else (case when l_returnflag = 'R' then 'failed' else 'completed' end) end as status, l_returnflag = 'R' as has_error from lineitem)""",
    }


def prefix(d: Dialect, tables: dict[str, str] | None = None) -> str:
    """The WITH clause of all views; ``tables`` maps source tables to SQL relations."""
    parts = [f"{t} as (select * from {rel})" for t, rel in (tables or {}).items()]
    parts += [f"{name} as {sql}" for name, sql in views(d).items()]
    return "with " + ",\n".join(parts)


DUCK_PREFIX = prefix(Dialect(spark=False))


def _needed(name: str, sql: dict[str, str]) -> list[str]:
    """The views that a view reads, in the order in which they are defined, itself last."""
    found, todo = set(), [name]
    while todo:
        v = todo.pop()
        if v in sql and v not in found:
            found.add(v)
            todo += re.findall(r"\b(?:from|join)\s+(\w+)", sql[v])
    return [v for v in sql if v in found]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the news model as a DataFrame, over the views and tables it needs."""
    sql = views(Dialect(spark=True, known=known(spark, sf_dir)))
    needed = _needed(name, sql)
    text = " ".join(sql[v] for v in needed)
    tables = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text)]
    return spark.sql("with " + ",\n".join([*tables, *(f"{v} as {sql[v]}" for v in needed)]) + f"\nselect * from {name}")


#: Counts by session and folder.
_COUNTED: dict[tuple[str, str], dict[str, int]] = {}


def known(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Row counts and the latest time of the source tables, one small query for each
    folder that a session reads."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COUNTED:
        d = Dialect(spark=True)
        row = spark.sql(f"""select (select count(*) from parquet.`{sf_dir}/documents.parquet`) documents, n events, latest_us
            from (select count(*) n, max({d.us('ts')}) latest_us from parquet.`{sf_dir}/events.parquet`)""").first()
        _COUNTED[key] = {k: v for k, v in row.asDict().items() if v is not None}
    return _COUNTED[key]
