"""Queries over the lists of the administration and of tools; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.operators import daily, lists
from pressline.plans.detail import _pick
from pressline.plans.messages import REPORT
from pressline.plans.sql_events import q
from pressline.sources.adapter import view


def _runs(spark, d):
    r = view(spark, d, "run")
    return r.select("id", (F.col("raw_item_id") % 20).alias("source_id"), "status", (F.col("id") * 1000).alias("started_us"))


def run_page(spark, d):
    """The second page of the failed runs of a source, and how many there are."""
    page, total = lists.run_page(_runs(spark, d), 7, "failed", True, 100, 100)
    return page.select("id", "started_us").withColumn("total", total.scalar())


RUNS_SQL = q("r as (select id, id * 1000 started_us, row_number() over (order by id desc) n, count(*) over () total from run where raw_item_id % 20 = 7 and status = 'failed')", "select id, started_us, total from r where n between 101 and 200")


def _reports(spark, d):
    report = daily.daily_report(view(spark, d, "item"), view(spark, d, "mention")).withColumn("report_date", F.col("report_date").cast("string"))
    n = F.dayofmonth(F.to_date("report_date"))
    heads = report.select("report_date").distinct().select(n.cast("long").alias("id"), "report_date", F.when(n % 4 == 0, "draft").otherwise("published").alias("status"), F.lit(1).cast("long").alias("updated_us"))
    return heads, report


def report_list(spark, d):
    """Summaries of the reports; a third of the messages is no longer visible, and two days are withdrawn."""
    heads, report = _reports(spark, d)
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-05",), ("1999-01-01",)], "report_date string")
    s = lists.report_summaries(lists.withdrawn(heads, days, 2), report, view(spark, d, "item").where("id % 3 > 0").select("id"))
    return s.select("id", "report_date", "status", "item_count", F.array_join(F.transform(F.array_sort(F.map_entries("section_counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("sections"))


REPORTS_SQL = q(
    REPORT + ", h as (select distinct report_date, day(report_date::date) n from report), s as (select *, case when report_date = '2024-01-05' then 'withdrawn' when n % 4 = 0 then 'draft' else 'published' end status from h), c as (select s.report_date, section, count(*) k from s join report r using (report_date) where status <> 'published' or r.id % 3 > 0 group by all)",
    "select n::bigint id, s.report_date, status, coalesce(sum(k), 0)::bigint item_count, coalesce(string_agg(section || ':' || k, ',' order by section), '') sections from s left join c using (report_date) group by all",
)


def evaluation_export(spark, d):
    """Cases of the reviews that a frame of ids names."""
    jobs = view(spark, d, "job")
    reviews = jobs.select("id", F.col("raw_item_id").alias("item_id"), "stage", F.concat(F.lit("p"), F.col("attempts").cast("string")).alias("proposal"), F.when(F.col("id") % 2 == 0, "fine").alias("feedback"))
    items = view(spark, d, "item").select("id", "title", F.lit("[]").alias("blocks"))
    ids = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 7").select("l_orderkey")
    return lists.evaluation_cases(reviews, items, ids).select("case_id", "task", "input.raw_item_id", "input.title", "model_output", "correction", "source_review_id")


EXPORT_SQL = q("z as (select 1)", "select 'review-' || j.id case_id, stage task, j.raw_item_id, i.title, 'p' || attempts model_output, case when j.id % 2 = 0 then 'fine' end correction, j.id source_review_id from job j left join item i on i.id = j.raw_item_id where j.id in (select l_orderkey from lineitem where l_linenumber = 7)")


def news_tool(spark, d):
    """The third page of a tool's search, with the events of its messages."""
    i = view(spark, d, "item").withColumns({"topics": F.array("topic"), "source_reliability_score": F.lit(0.5), "source_url": F.concat(F.lit("https://h.example.org/"), F.col("id").cast("string"))})
    found = lists.news_tool(i, view(spark, d, "mention"), "importance", "desc", 50, 100)
    return found.select("id", "title", F.array_join("products", ",").alias("products"), "importance_score", "source_url", F.array_join("related_event_ids", ",").alias("events"), "total", "has_more")


NEWS_SQL = q(
    "o as (select *, row_number() over (order by importance_score desc nulls first, id desc) n, count(*) over () total from item where status = 'published')",
    "select o.id, title, array_to_string(products, ',') products, importance_score, 'https://h.example.org/' || o.id source_url, coalesce((select string_agg(event_id, ',' order by event_id) from (select distinct event_id from mention m where m.item_id = o.id)), '') events, total, total > 150 has_more from o where n between 101 and 150",
)


def newest_jobs(spark, d):
    """The newest failed jobs, as many as the list shows."""
    return lists.newest(view(spark, d, "job"), "jobs", "created_us", status="failed", stage=None).select("id", "created_us", _pick(F.col("id"), ("a", "b")).alias("mark"))


JOBS_SQL = q("z as (select 1)", "select id, created_us, (['a', 'b'])[id % 2 + 1] mark from job where status = 'failed' order by created_us desc, id desc limit 500")

QUERIES = {"run_page": run_page, "report_list": report_list, "evaluation_export": evaluation_export, "news_tool": news_tool, "newest_jobs": newest_jobs}
SQL = {"run_page": RUNS_SQL, "report_list": REPORTS_SQL, "evaluation_export": EXPORT_SQL, "news_tool": NEWS_SQL, "newest_jobs": JOBS_SQL}
