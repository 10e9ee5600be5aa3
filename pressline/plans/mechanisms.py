"""Queries over cascades, merges, kept stages, cells, key pages, counters and closing days;
with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.operators import closure, layout, pages, stages
from pressline.plans.layout import LINES, _lines
from pressline.plans.sql_events import q
from pressline.sources.adapter import view
from pressline.streaming import counters, jobs, reports


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- cascade

REFERENCES = [
    ("customer", "nation", "nation"), ("supplier", "nation", "nation"), ("orders", "customer", "customer"), ("lineitem", "order", "orders"), ("lineitem", "supplier", "supplier"),
    ("document", "supersedes", "document"), ("document", "cause", "orders"), ("customer", "referrer", "document"),
]


def _tables(spark, d):
    c = F.col
    return {
        "nation": _table(spark, d, "nation").select(c("n_nationkey").alias("id")),
        "customer": _table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation"), F.when(c("c_custkey") % 5 == 0, c("c_custkey") * 2).alias("referrer")),
        "supplier": _table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_nationkey").alias("nation")),
        "orders": _table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("customer")),
        "lineitem": _table(spark, d, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), c("l_orderkey").alias("order"), c("l_suppkey").alias("supplier")),
        "document": _table(spark, d, "documents").select(c("doc_id").alias("id"), F.when(c("doc_id") % 100 >= 80, c("doc_id") - 20).alias("supersedes"), F.when(c("doc_id") % 3 == 0, c("doc_id")).alias("cause")),
    }


def cascade_delete(spark, d):
    """Every row that goes with two nations: four levels, a table that refers to itself and a ring."""
    tables = _tables(spark, d)
    return closure.cascade(tables, REFERENCES, {"nation": tables["nation"].where(F.col("id").isin(3, 11))}).drop("round")


CASCADE_SQL = """
with recursive edge as (
    select 'nation' pt, c_nationkey::bigint pid, 'customer' ct, c_custkey::bigint cid from customer
    union all select 'nation', s_nationkey, 'supplier', s_suppkey from supplier
    union all select 'customer', o_custkey, 'orders', o_orderkey from orders
    union all select 'orders', l_orderkey, 'lineitem', l_orderkey * 8 + l_linenumber from lineitem
    union all select 'supplier', l_suppkey, 'lineitem', l_orderkey * 8 + l_linenumber from lineitem
    union all select 'document', doc_id - 20, 'document', doc_id from documents where doc_id % 100 >= 80
    union all select 'orders', doc_id, 'document', doc_id from documents where doc_id % 3 = 0
    union all select 'document', c_custkey * 2, 'customer', c_custkey from customer where c_custkey % 5 = 0),
gone as (select 'nation' as t, n_nationkey::bigint id from nation where n_nationkey in (3, 11) union select ct, cid from gone join edge on pt = t and pid = id)
select t as "table", id from gone
"""

# ---- merge


def merged_balances(spark, d):
    """Customers with the price of their latest order as balance; orders of unknown customers open new rows."""
    target = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"))
    source = _table(spark, d, "orders").select((F.col("o_custkey") + 40).alias("id"), "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("price"))
    assign = {"balance": F.col("s.price"), "name": F.concat(F.lit("order "), F.col("s.o_orderkey").cast("string"))}
    return closure.update_from(target, source, ["id"], assign, [F.desc("o_orderdate"), F.desc("o_orderkey")], insert=True)


MERGE_SQL = """
with s as (select o_custkey + 40 id, o_orderkey, o_totalprice::double price from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select id, case when s.id is null then c_name else 'order ' || o_orderkey end as name, coalesce(price, c_acctbal::double) as balance
from (select c_custkey id, c_name, c_acctbal from customer) c full join s using (id)
"""

# ---- kept stages


def _stages():
    said = lambda expression: lambda rows: rows.select("id", expression.alias("output"))
    return [
        stages.Stage("analysis", ("lang",), ("translation",), said(F.md5(F.concat("translation", F.coalesce("lang", F.lit(""))).cast("binary")))),
        stages.Stage("relevance", ("content",), (), said(F.when(F.length("content") % 7 > 0, "keep"))),
        stages.Stage("translation", ("content",), ("relevance",), said(F.md5(F.col("content").cast("binary")))),
        stages.Stage("importance", (), ("relevance",), said(F.concat(F.lit("i:"), "relevance"))),
    ]


def staged_rerun(spark, d):
    """The second run over messages of which a tenth has a new text and a tenth a new language."""
    first = view(spark, d, "item").select("id", "content", "lang")
    kept = stages.run_stages(first, _stages())
    text = F.when(F.col("id") % 10 == 3, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    edited = first.select("id", text.alias("content"), F.when(F.col("id") % 10 == 4, "xx").otherwise(F.col("lang")).alias("lang"))
    out = None
    for name, t in stages.run_stages(edited, _stages(), kept).items():
        rows = t.select(F.lit(name).alias("stage"), "id", "computed", "output")
        out = rows if out is None else out.unionByName(rows)
    return out


STAGED_SQL = q(
    """m as (select id, content c0, lang l0, case when id % 10 = 3 then content || ' edited' else content end c1, case when id % 10 = 4 then 'xx' else lang end l1 from item),
    r as (select *, length(c0) % 7 > 0 r0, length(c1) % 7 > 0 r1 from m)""",
    """select 'relevance' stage, id, id % 10 = 3 computed, case when r1 then 'keep' end as output from r
    union all select 'translation', id, not r0 or id % 10 = 3, md5(c1) from r where r1
    union all select 'analysis', id, not r0 or id % 10 = 3 or (id % 10 = 4 and l0 is distinct from l1), md5(md5(c1) || coalesce(l1, '')) from r where r1
    union all select 'importance', id, not r0, 'i:keep' from r where r1""",
)

# ---- cells


def _table_lines(spark, d):
    return _lines(spark, d).withColumn("confidence", F.when((F.col("line") + F.col("image_id")) % 5 > 0, (F.col("line") * 7 % 10 + 1) / 11))


def _boundaries(lines):
    """A boundary every 40 pixels down to the lowest line, and one close behind another;
    dealt by the hint, so that two uses share them."""
    low = lines.groupBy("image_id").agg(F.max("y1").alias("low"))
    every = F.concat(F.sequence(F.lit(0), F.col("low") + 40, F.lit(40)), F.array(F.lit(45).cast("long")))
    return low.select("image_id", F.explode(F.transform(every, lambda y: y.cast("int"))).alias("y")).hint("rebalance", "image_id")


def _cells(spark, d):
    lines = _table_lines(spark, d)
    dividers = layout.divider(lines)
    return layout.cells(lines, _boundaries(lines), dividers), lines, dividers


def patch_cells(spark, d):
    return _cells(spark, d)[0].select("image_id", "y0", "y1", "section_type", "section_label", "target", F.size("raw_changes").alias("n_changes"), F.round("confidence", 6).alias("confidence"))


def patch_confidence(spark, d):
    records, lines, dividers = _cells(spark, d)
    return layout.structure_confidence(records, _boundaries(lines), dividers)


CELLS = (
    LINES
    + """,
div as (select t.image_id, case when b.n >= need then round(md)::int end divider_x, case when b.n >= need then least(1.0, b.n / 8) else coalesce(b.n / need, 0) end support from tot t left join bst b using (image_id)),
low as (select image_id, max(y0) + 12 low from typed group by 1),
edge as (select image_id, unnest(range(0, (low + 41)::bigint, 40)) y from low union select image_id, 45 from low),
band0 as (select image_id, y y0, lead(y) over (partition by image_id order by y) y1 from edge),
band as (select * from band0 where y1 - y0 >= 11),
headed as (select b.*, arg_max(h.st, (h.cy, h.line)) section_type, arg_max(h.text, (h.cy, h.line)) section_label from band b join typed h on h.image_id = b.image_id and h.st is not null and h.cy < (b.y0 + b.y1) / 2 group by all),
deco as (select distinct l.image_id, l.line from typed l join typed h on h.image_id = l.image_id and h.st is not null and l.st is null and length(trim(l.text, ' ')) <= 3 and l.x0 < h.x0 and 200 <= 18
    and greatest(0, least(l.y0, h.y0) + 12 - greatest(l.y0, h.y0)) / 12 >= 0.55 and h.x0 - l.x0 - 200 between -3 and 12),
inside as (select b.*, l.line, l.text, l.x0, l.y0 ly0, (l.line * 7 % 10 + 1) / 11 conf, (l.line + l.image_id) % 5 > 0 sure, coalesce(l.x0 < divider_x - 8, true) lft
    from headed b join typed l on l.image_id = b.image_id and l.st is null and l.cy >= b.y0 and l.cy < b.y1 left join div on div.image_id = b.image_id where (l.image_id, l.line) not in (select * from deco)),
rec as (select image_id, y0, y1, section_type, section_label, string_agg(trim(text, ' '), ' ' order by ly0, x0, line) filter (lft and trim(text, ' ') <> '') target, count(distinct line // 2) filter (not lft) n_changes, coalesce(avg(conf) filter (sure), 0) confidence from inside group by all),
record as (select * from rec where target <> ''),
sg as (select *, lag(section_type) over w is distinct from section_type or lag(section_label) over w is distinct from section_label ch from record window w as (partition by image_id order by y0)),
per as (select image_id, count(*) records, sum(ch::int)::bigint sections, sum((n_changes > 0)::int)::bigint paired from sg group by 1),
ne as (select image_id, count(*) edges from edge group by 1)"""
)
CELLS_SQL = q(CELLS, "select image_id, y0, y1, section_type, section_label, target, n_changes, round(confidence, 6) confidence from record")
CONFIDENCE_SQL = q(
    CELLS + ", s as (select image_id, coalesce(records, 0) records, coalesce(sections, 0) sections, coalesce(paired, 0) paired, divider_x, 0.35 * support + 0.25 * least(1.0, edges / greatest(4, coalesce(records, 0) + 1)) + 0.3 * coalesce(paired / records, 0) + 0.1 * least(1.0, coalesce(sections, 0) / 3) c from ne left join per using (image_id) left join div using (image_id))",
    "select image_id, records, sections, paired, round(case when divider_x is null then least(c, 0.35) else c end, 6) confidence from s",
)

# ---- pages

PAGE_KEYS = [pages.Key("importance_score", descending=True), pages.Key("published_us", nulls_first=True), pages.Key("id", descending=True)]


def tool_pages(spark, d):
    """The first two pages of fifty published messages, the second behind the first one's last row."""
    rows = view(spark, d, "item").where("status = 'published'").select("id", "importance_score", "published_us")
    first = pages.page(rows, PAGE_KEYS, 50, most=pages.TOOL_LIMIT)
    last = first.agg(F.max_by("cursor", "position")).first()[0]
    second = pages.page(rows, PAGE_KEYS, 50, last, most=pages.TOOL_LIMIT)
    both = first.select(F.lit(1).alias("page"), "position", "id", "has_more").unionByName(second.select(F.lit(2).alias("page"), "position", "id", "has_more"))
    return both


PAGES_SQL = q(
    "o as (select id, row_number() over (order by importance_score desc nulls last, published_us asc nulls first, id desc) n, count(*) over () total from item where status = 'published')",
    "select ((n - 1) // 50 + 1)::int as page, ((n - 1) % 50 + 1)::int as position, id, total > ((n - 1) // 50 + 1) * 50 as has_more from o where n <= 100",
)

# ---- streams


def run_counters(spark, d):
    """What an ingest run took in, counted by metrics that ride along."""
    arrivals = jobs.event_stream(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), F.sha2("event_type", 256).alias("content_hash"))
    revisions = counters.observed_revisions(jobs.ingested(counters.observed_arrivals(arrivals)))
    base = jobs.shared_folder(spark)
    start = lambda: revisions.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    return counters.as_frame(spark, counters.counted_run(spark, start)).drop("error")


COUNTERS_SQL = """
with a as (select user_id as key, event_id, lag(event_type) over w is distinct from event_type c from events window w as (partition by user_id order by event_id)),
r as (select count(*) n, count(*) filter (c) made, count(distinct key) created from a)
select n discovered, created, made - created revised, n - made skipped, 'completed' status from r
"""


def stream_report_close(spark, d):
    updates = reports.report_updates(jobs.event_stream(spark, d))
    with reports.with_rocks(spark):
        return jobs.run_available(reports.closing_stream(updates))


def report_close(spark, d):
    events = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return reports.closing_table(reports.report_updates(events))


CLOSE_SQL = """
with e as (select epoch_us(ts) us, ((epoch_us(ts) + 28800000000) // 86400000000 - case when user_id % 7 = 0 then 1 else 0 end)::int dn from events),
s as (select *, (dn + 1)::bigint * 86400000000 - 28800000000 due from e),
d as (select dn, due, count(*) filter (us <= due) n, count(*) filter (us > due and us <= due + 900000000) g, ((select max(us) from e) - 3600000000) // 1000 as now from s group by 1, 2)
select (date '1970-01-01' + dn)::varchar report_date, 'closed' as "action", due at_us, n updates from d where due // 1000 <= now
union all select (date '1970-01-01' + dn)::varchar, 'regenerated', due + 900000000, n + g from d where g > 0 and (due + 900000000) // 1000 <= now
"""

QUERIES = {
    "cascade_delete": cascade_delete, "merged_balances": merged_balances, "staged_rerun": staged_rerun, "patch_cells": patch_cells, "patch_confidence": patch_confidence, "tool_pages": tool_pages,
    "run_counters": run_counters, "stream_report_close": stream_report_close, "report_close": report_close,
}
SQL = {
    "cascade_delete": CASCADE_SQL, "merged_balances": MERGE_SQL, "staged_rerun": STAGED_SQL, "patch_cells": CELLS_SQL, "patch_confidence": CONFIDENCE_SQL, "tool_pages": PAGES_SQL,
    "run_counters": COUNTERS_SQL, "stream_report_close": CLOSE_SQL, "report_close": CLOSE_SQL,
}
