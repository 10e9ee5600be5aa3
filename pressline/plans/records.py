"""Queries over platform records, evaluation files, traces and stored reports; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.functions.lineage import shared_dir
from pressline.operators import daily
from pressline.plans.detail import _pick
from pressline.plans.messages import REPORT
from pressline.plans.sql_events import q
from pressline.sources import connectors, files, platforms
from pressline.sources.adapter import view


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _posts(spark, d):
    """conv_id, turn, k and words (letters alone) of the posts that users wrote."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return _table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("k"), words.alias("words"))


def _shown(blocks):
    return F.array_join(F.transform(blocks, lambda b: F.concat_ws("~", b["type"], b["embed_kind"], b["text"], b["source_url"], b["mime_type"], b["alt_text"])), "\n")


def tweet_records(spark, d):
    """Posts written as tweets and mapped back: short links, photos, videos, quotations, repeats."""
    k = F.col("k")
    s = lambda x: x.cast("string")
    link = lambda u, t, label: F.struct(F.lit(u).alias("url"), F.lit(t).alias("tcourl"), label.alias("text"))
    photo = F.struct(F.concat(F.lit("https://p.example.org/"), s(k), F.lit(".jpg")).alias("url"), F.lit(" alt ").alias("altText"))
    tweet = F.struct(
        F.concat(F.lit("t"), s(k)).alias("id_str"), F.when(k % 2 == 0, F.concat(F.lit("https://x.com/a/status/"), s(k))).alias("url"), F.concat(F.lit("2024-03-0"), s(k % 9 + 1), F.lit("T01:02:03+00:00")).alias("date"), F.lit("en").alias("lang"),
        F.struct(F.lit("acct").alias("username"), F.concat(F.lit(" Name "), s(k % 5)).alias("displayname")).alias("user"), F.concat("words", F.lit(" https://t.co/a1 tail\n\n\n\nhttps://t.co/b2"), F.when(k % 5 == 0, " https://t.co/zz").otherwise("")).alias("rawContent"),
        F.array(link("https://news.example.org/x", "https://t.co/a1", F.when(k % 3 > 0, "label")), link("https://youtu.be/v", "https://t.co/b2", F.lit(None).cast("string"))).alias("links"), F.struct(F.when(k % 3 == 0, F.array(photo)).alias("photos"), F.when(k % 7 == 0, F.array(F.struct(F.lit("v").alias("url")))).alias("videos")).alias("media"),
        F.when(k % 4 == 0, F.struct(F.lit("https://x.com/q/status/1").alias("url"), F.lit("1").alias("id_str"))).alias("quotedTweet"), F.lit("not kept").alias("secret"),
    )
    rows = _posts(spark, d).select("conv_id", "turn", F.to_json(tweet).alias("value"))
    t = platforms.tweets(rows)
    return t.select("conv_id", "turn", "external_id", "url", "author", F.unix_micros("published_at").alias("published_us"), _shown("blocks").alias("blocks"), "quoted_id", F.array_join(F.array_sort(F.json_object_keys("response")), ",").alias("kept"), "rejected")


TWEETS_SQL = """
with p as (select conv_id, turn, conv_id * 7 + turn k, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) words from conversations where role = 'user'),
b as (select *, case when k % 2 = 0 then 'https://x.com/a/status/' || k else 'https://x.com/acct/status/t' || k end url0, case when words = '' then '' else words || ' ' end || case when k % 3 > 0 then 'label' else 'news.example.org' end || ' tail'
    || case when k % 5 = 0 then chr(10) || chr(10) || 'youtu.be' else '' end body from p)
select conv_id, turn, 't' || k external_id, url0 as url, 'Name ' || k % 5 author, 1709254923000000 + (k % 9) * 86400000000 published_us,
    'paragraph~' || body || case when k % 3 = 0 then chr(10) || 'image~https://p.example.org/' || k || '.jpg~image/jpeg~alt' else '' end || case when k % 4 = 0 then chr(10) || 'embed~quoted_post~引用推文~https://x.com/q/status/1' else '' end
    || case when k % 7 = 0 then chr(10) || 'embed~video~视频~' || url0 else '' end || chr(10) || 'embed~external_link~外部链接~https://news.example.org/x' || chr(10) || 'embed~video~外部视频~https://youtu.be/v'
    || case when k % 5 = 0 and k % 3 > 0 and k % 4 > 0 and k % 7 > 0 then chr(10) || 'embed~external_link~外部链接~https://t.co/zz' else '' end as blocks,
    case when k % 4 = 0 then '1' end quoted_id, 'date,id_str,lang,links,media,rawContent' || case when k % 2 = 0 then ',url' else '' end kept, false rejected
from b
"""


def weibo_records(spark, d):
    """Posts written as microblog records and mapped back: pictures, reposts, attachments."""
    k = F.col("k")
    s = lambda x: x.cast("string")
    entry = F.struct(F.lit("http://t.cn/s").alias("short_url"), _pick(k, ("https://video.weibo.com/1", "https://n.example.org/1", "no address")).alias("long_url"), F.when(k % 2 == 0, "Title").alias("url_title"))
    post = F.struct(
        k.alias("mid"), F.when(k % 3 > 0, F.concat(F.lit("B"), s(k))).alias("mblogid"), F.lit("Fri Mar 01 09:02:03 +0800 2024").alias("created_at"), F.concat(F.lit("<b>"), "words", F.lit("</b> http://t.cn/s<br/>end &amp; ")).alias("text_raw"),
        F.when(k % 11 > 0, F.struct((k % 40 + 1).alias("id"), F.lit("who").alias("screen_name"))).alias("user"), F.when(k % 4 == 0, F.array(F.concat(F.lit("pic"), s(k)))).alias("pic_ids"), F.array(entry).alias("url_struct"), F.lit("secret").alias("ip"),
        F.when(k % 5 == 0, F.struct(F.lit(3).alias("id"), F.lit("up").alias("text"), F.struct(F.lit(8).alias("id"), F.lit("u").alias("screen_name")).alias("user"), F.lit("x").alias("ip"))).alias("retweeted_status"),
    )
    w = platforms.weibo_posts(_posts(spark, d).select("conv_id", "turn", F.to_json(post).alias("value")))
    kept = F.array_join(F.array_sort(F.json_object_keys("response")), ",")
    return w.select("conv_id", "turn", "external_id", "url", "author", F.unix_micros("published_at").alias("published_us"), _shown("blocks").alias("blocks"), "quoted_url", kept.alias("kept"), "rejected")


WEIBO_SQL = """
with p as (select conv_id, turn, conv_id * 7 + turn k, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) words from conversations where role = 'user'),
b as (select *, k % 11 > 0 whole, case when k % 11 > 0 then 'https://weibo.com/' || k % 40 + 1 || '/' || case when k % 3 > 0 then 'B' || k else k::varchar end else 'https://weibo.com//' || case when k % 3 > 0 then 'B' || k else k::varchar end end url0 from p)
select conv_id, turn, k::varchar external_id, url0 as url, case when whole then 'who' end author, 1709254923000000 published_us,
    'paragraph~' || case when words = '' then '' else words || chr(10) || chr(10) end || 'end &' || case when k % 4 = 0 then chr(10) || 'image~https://wx1.sinaimg.cn/orj960/pic' || k else '' end
    || case when k % 5 = 0 then chr(10) || 'quote~转发自 @u：up' || chr(10) || 'embed~quoted_post~原微博~https://weibo.com/8/3' else '' end
    || case k % 3 when 0 then chr(10) || 'embed~video~' || case when k % 2 = 0 then 'Title' else '网页链接' end || '~https://video.weibo.com/1' when 1 then chr(10) || 'embed~external_link~' || case when k % 2 = 0 then 'Title' else '网页链接' end || '~https://n.example.org/1' else '' end as blocks,
    case when k % 5 = 0 then 'https://weibo.com/8/3' end quoted_url, 'created_at' || case when k % 3 > 0 then ',mblogid' else '' end || ',mid' || case when k % 4 = 0 then ',pic_ids' else '' end || case when k % 5 = 0 then ',retweeted_status' else '' end || ',text_raw,url_struct' || case when whole then ',user' else '' end kept, not whole rejected
from b
"""


def thread_floors(spark, d):
    """Threads as candidates: a heading and a paragraph for each floor."""
    c = connectors.collect(_table(spark, d, "conversations"), "baidu_tieba", "baidu_tieba").candidates
    return c.select("external_id", "canonical_url", F.size("blocks").alias("n"), F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["type"], b["level"].cast("string"), b["text"])), "\n").alias("text"))


FLOORS_SQL = "select conv_id::varchar external_id, 'https://tieba.baidu.com/p/' || conv_id canonical_url, count(*) * 2 n, string_agg('heading:3:Floor ' || turn || chr(10) || 'paragraph:' || trim(text, ' '), chr(10) order by turn, text) as text from conversations where role = 'user' and length(trim(text, ' ')) > 0 group by conv_id"


def case_files(spark, d):
    """Evaluation cases written as JSON lines, some broken, read back with their rejects."""
    k = F.col("doc_id")
    task = _pick(k, (*files.TASKS, "other"))
    line = F.when(k % 13 == 0, "{broken").otherwise(F.to_json(F.struct(k.cast("string").alias("case_id"), task.alias("task"), F.when(k % 11 > 0, "v1").alias("dataset_version"), F.lit("{}").alias("expected"))))
    path = f"{shared_dir(spark)}/cases-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    _table(spark, d, "labels").select("doc_id").distinct().select(line.alias("value")).write.mode("overwrite").text(path)
    good, bad = files.read_cases(spark, path)
    return good.groupBy(F.col("task").alias("what")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")))


CASES_SQL = f"""
with c as (select distinct doc_id k from labels), r as (select k, ({[*files.TASKS, 'other']})[k % {len(files.TASKS) + 1} + 1] task, case when k % 13 = 0 then 'invalid JSON' when k % 11 = 0 then 'missing key' when k % {len(files.TASKS) + 1} = {len(files.TASKS)} then 'unsupported task' end why from c)
select coalesce(why, task) what, count(*) n from r group by 1
"""


def stored_report(spark, d):
    """The daily report written by days, two days of it written again in another version, and read back."""
    report = daily.daily_report(view(spark, d, "item"), view(spark, d, "mention")).withColumn("report_date", F.col("report_date").cast("string")).withColumn("version", F.lit(1))
    path = f"{shared_dir(spark)}/report-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    report.write.mode("overwrite").partitionBy("report_date").parquet(path)
    again = report.where(F.col("report_date").isin("2024-01-05", "2024-01-09")).withColumn("version", F.lit(2))
    files.overwrite_days(again, path)
    return spark.read.parquet(path).select(F.col("report_date").cast("string"), "section", "position", "id", "version")


STORED_SQL = q(REPORT, "select report_date, section, position, id, case when report_date in ('2024-01-05', '2024-01-09') then 2 else 1 end as version from report")


def trace_sums(spark, d):
    """Calls, tokens and latency of the traces in the newest thousand checkpoints, at any depth."""
    n, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    text = F.concat(F.lit('{"a":{"b":{"model":"m","usage":{"total_tokens":'), part, F.lit('},"in":{"model":"not outermost"}}},"c":{"prompt_name":"p","latency_ms":'), n, F.lit('},"d":[{"model":"in a list"}]}'))
    rows = _table(spark, d, "lineitem").select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id"), text.alias("snapshot"))
    return files.trace_totals(rows).withColumn("latency_ms", F.round("latency_ms", 6))


TRACES_SQL = "with n as (select l_partkey, l_linenumber from lineitem order by (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey desc limit 1000) select count(*) * 2 calls, sum(l_partkey)::bigint tokens, round(sum(l_linenumber) / (2 * count(*)), 6) latency_ms from n"


def payload_defaults(spark, d):
    """Providers of payloads, with a default where there is none; the latest five hundred."""
    e = _table(spark, d, "events").select("event_id", F.concat(F.lit('{"provider":"'), _pick(F.col("event_id"), ("", "p1", "p2")), F.lit('","k":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}")).alias("payload"))
    provider = F.coalesce(F.nullif(F.get_json_object("payload", "$.provider"), F.lit("")), F.lit("default"))
    return e.select("event_id", provider.alias("provider"), F.get_json_object("payload", "$.k").alias("k")).orderBy(F.desc("event_id")).limit(500)


def platform_times(spark, d):
    """Times of events as platforms write them, read back; some are no times."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    connector = _pick(k, ("weibo", "baidu_tieba", "tencent_lol", "x_twitter"))
    text = _pick(k, (F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy"), F.unix_timestamp(ts).cast("string"), F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    text = F.when(k % 9 == 8, _pick(k, ("soon", "0", "2024-01-01", " "))).otherwise(text)
    return _table(spark, d, "events").select("event_id", platforms.platform_micros(connector, text).alias("us"))


TIMES_SQL = "select event_id, case when event_id % 9 = 8 then null else epoch_us(ts) // 1000000 * 1000000 end us from events"
DEFAULTS_SQL = "select event_id, coalesce(nullif((['', 'p1', 'p2'])[event_id % 3 + 1], ''), 'default') provider, json_extract_string(props, '$.k') k from events order by event_id desc limit 500"

QUERIES = {"tweet_records": tweet_records, "weibo_records": weibo_records, "thread_floors": thread_floors, "case_files": case_files, "stored_report": stored_report, "trace_sums": trace_sums, "payload_defaults": payload_defaults, "platform_times": platform_times}
SQL = {"tweet_records": TWEETS_SQL, "weibo_records": WEIBO_SQL, "thread_floors": FLOORS_SQL, "case_files": CASES_SQL, "stored_report": STORED_SQL, "trace_sums": TRACES_SQL, "payload_defaults": DEFAULTS_SQL, "platform_times": TIMES_SQL}
