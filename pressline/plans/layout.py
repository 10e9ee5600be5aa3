"""Queries over recognised lines, packing and lookups; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions import packing
from pressline.operators import layout
from pressline.plans.sql_events import q
from pressline.sources import files
from pressline.sources.adapter import view

_HEADS = ("CHAMPION BUFFS", "Item  nerfs", "RUNE ADJUSTMENTS", "SYSTEM BUFF")


def _texts(spark, d):
    """Id and text of the raw records. Which records there are is found by ids alone, so that
    each text moves once, to where its image is put together."""
    documents = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    counts = documents.groupBy("id").agg(F.count("*").alias("own"))
    times = view(spark, d, "raw").groupBy("id").agg(F.count("*").alias("all")).join(counts, "id").select("id", F.expr("all div own").alias("times"))
    return documents.join(times, "id").select("id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("id", "text")


def _lines(spark, d):
    """The lines of each document as recognised lines of an image: every seventh a heading."""
    words = _texts(spark, d).select(F.col("id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    i, n = F.col("line"), F.col("image_id")
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.floor((n + i) / 7) % 4 + 1).cast("int"))
    x0 = F.when(i % 3 == 0, 20 + n % 5).otherwise(180 + (n + i) % 9)
    y0 = F.floor(i / 2) * 20 + i % 3
    return words.select("image_id", "line", F.when(i % 7 == 0, head).otherwise(F.col("text")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 12).alias("y1"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))


def _records(spark, d):
    return layout.lines_in_sections(_lines(spark, d)).withColumn("position", F.col("line"))


def chunk_packing(spark, d):
    c = view(spark, d, "raw").select("id", F.explode(packing.chunk_numbers(F.split("text", "\n"), 5, 800)).alias("chunk"))
    return c.groupBy("id", "chunk").agg(F.count("*").alias("blocks"))


def weekly_lookup(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    issues = o.groupBy(F.col("o_orderkey").alias("issue")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), " , ").alias("ids"))
    names = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 2).alias("id"), F.concat(F.lit("s"), F.col("s_suppkey") * 2).alias("name"))
    return files.lookup_list(issues, names)


def error_classes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    i = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    connector, kind, message = pick("x_twitter", "weibo", "baidu_tieba", "manual"), pick("configuration", "collection", "lookup"), pick("Missing cookie", "was rate limited", "request Rejected", "page no longer exists", "登录", "timeout", "unsupported value")
    return e.select(i.alias("id"), packing.collection_error(connector, kind, message).alias("error_class"), packing.is_retryable(kind, message).alias("retryable"))


QUERIES = {
    "patch_sections": lambda s, d: layout.lines_in_sections(_lines(s, d)).select("image_id", "line", "section_type", "section_label"),
    "patch_section_groups": lambda s, d: layout.section_groups(_records(s, d)),
    "patch_divider": lambda s, d: layout.divider(_lines(s, d)).select("image_id", "divider_x", F.round("support", 6).alias("support")),
    "patch_rows": lambda s, d: layout.visual_rows(_lines(s, d), ["image_id"]),
    "chunk_packing": chunk_packing,
    "lookup_list": weekly_lookup,
    "error_classes": error_classes,
}

LINES = """
ln as (select id image_id, unnest(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10)))::bigint))) z from raw),
lines as (select image_id, z[2] line, case when z[2] % 7 = 0 then (['CHAMPION BUFFS', 'Item  nerfs', 'RUNE ADJUSTMENTS', 'SYSTEM BUFF'])[((image_id + z[2]) // 7) % 4 + 1] else z[1] end as text,
   case when z[2] % 3 = 0 then 20 + image_id % 5 else 180 + (image_id + z[2]) % 9 end x0, (z[2] // 2) * 20 + z[2] % 3 y0 from ln),
typed as (select *, y0 + 6.0 cy, case when regexp_matches(upper(text), 'CHAMPION') and regexp_matches(upper(text), 'BUFF') then 'champion_buff' when regexp_matches(upper(text), 'CHAMPION') and regexp_matches(upper(text), 'NERF') then 'champion_nerf' when regexp_matches(upper(text), 'SYSTEM') and regexp_matches(upper(text), 'BUFF') then 'system_buff'
   when regexp_matches(upper(text), 'ITEM') and regexp_matches(upper(text), 'NERF') then 'item_nerf' when regexp_matches(upper(text), 'RUNE') and regexp_matches(upper(text), 'ADJUST') then 'rune_adjustment' end st from lines),
sec as (select l.image_id, l.line, arg_max(h.st, (h.cy, -h.line)) section_type, arg_max(h.text, (h.cy, -h.line)) section_label from typed l join typed h on h.image_id = l.image_id and h.st is not null and h.cy < l.cy where l.st is null group by 1, 2),
g1 as (select *, lag(section_type) over w is distinct from section_type or lag(section_label) over w is distinct from section_label or row_number() over w = 1 ch from sec window w as (partition by image_id order by line)),
g2 as (select *, sum(ch::int) over (partition by image_id order by line)::bigint g from g1),
cand as (select image_id, x0 from typed where st is null and x0 between 120 and 350),
cl as (select a.image_id, a.x0, count(*) n, median(b.x0) md from (select distinct image_id, x0 from cand) a join cand b on b.image_id = a.image_id and abs(b.x0 - a.x0) <= 8 group by 1, 2),
bst as (select image_id, max(n) n, arg_max(md, (n, -md)) md from cl group by 1),
tot as (select image_id, count(*) n, greatest(3, round(count(*) * 0.07)) need from typed group by 1)"""
SQL = {
    "patch_sections": q(LINES, "select * from sec"),
    "patch_section_groups": q(LINES, "select image_id, g as \"group\", section_type, section_label, count(*) records, min(line) first_position from g2 group by 1, 2, 3, 4"),
    "patch_divider": q(LINES, "select t.image_id, case when b.n >= need then round(md)::int end divider_x, round(case when b.n >= need then least(1.0, b.n / 8) else coalesce(b.n / need, 0) end, 6) support from tot t left join bst b using (image_id)"),
    "patch_rows": q(LINES, "select image_id, (dense_rank() over (partition by image_id order by line // 2) - 1)::int as \"row\", coalesce(string_agg(trim(text, ' '), '  ' order by x0, text) filter (trim(text, ' ') <> ''), '') as text from typed group by image_id, line // 2"),
    "chunk_packing": q(
        """t as (select id, unnest(list_zip(range(1, len(string_split(text, chr(10)))::bigint + 1), string_split(text, chr(10)))) z from raw),
        p as (with recursive w as (select distinct id, 0::bigint i, 0::bigint n, 0::bigint c, 0 k from t union all select t.id, w.i + 1, case when f.y then 1 else n + 1 end, case when f.y then length(z[2]) + 80 else c + length(z[2]) + 80 end, case when f.y then k + 1 else k end
            from w join t on t.id = w.id and t.z[1] = w.i + 1, lateral (select w.n > 0 and (w.n >= 5 or w.c + length(z[2]) + 80 > 800) y) f) select * from w where i > 0)""",
        "select id, k chunk, count(*) blocks from p group by 1, 2",
    ),
    "lookup_list": "with l as (select l_orderkey issue, l_linenumber pos, l_suppkey, case when s_suppkey is not null then 's' || l_suppkey end nm from lineitem join orders on o_orderkey = l_orderkey left join supplier on 2 * s_suppkey = l_suppkey) select issue, coalesce(string_agg(nm, ',' order by pos, l_suppkey), '') \"names\", count(*) filter (nm is null) missing from l group by 1",
    "error_classes": """with e as (select event_id id, (['x_twitter', 'weibo', 'baidu_tieba', 'manual'])[event_id % 4 + 1] c, (['configuration', 'collection', 'lookup'])[event_id % 3 + 1] k, lower((['Missing cookie', 'was rate limited', 'request Rejected', 'page no longer exists', '登录', 'timeout', 'unsupported value'])[event_id % 7 + 1]) m from events where event_type = 'error')
      select id, case when k = 'configuration' and c = 'x_twitter' then (case when regexp_matches(m, 'cookie|auth|login|ct0|token') then 'authentication' else 'configuration' end) when k = 'configuration' and c = 'weibo' then (case when regexp_matches(m, 'login|profile|cookie|登录') then 'authentication' else 'configuration' end)
      when k = 'configuration' and c = 'baidu_tieba' then 'configuration' when c = 'x_twitter' then (case when m like '%rate limited%' then 'rate_limited' when regexp_matches(m, 'blocked|rejected') then 'upstream_rejected' else 'collection_failed' end) when c = 'weibo' and regexp_matches(m, 'reject|登录') then 'upstream_rejected' else 'collection_failed' end error_class,
      k <> 'lookup' and not regexp_matches(m, 'no longer exists|superseded|configuration|unsupported|no longer available') retryable from e""",
}
