"""Readers with rejects, lookup lists, partition overwrites, reports and schema checks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS = ("relevance", "translation", "analysis", "importance", "event")
CASE = "case_id string, task string, dataset_version string, expected string, notes string"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) evaluation cases of a JSON-lines folder; a rejected line keeps
    its text and says why. The reader parses once, in permissive mode."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = raw.withColumn("r", F.from_json("value", CASE))
    r = F.col("r")
    reason = (
        F.when(r.isNull() | (r["case_id"].isNull() & r["task"].isNull() & r["expected"].isNull()), "invalid JSON")
        .when(r["case_id"].isNull() | r["task"].isNull() | r["dataset_version"].isNull() | r["expected"].isNull(), "missing key").when(~r["task"].isin(*TASKS), "unsupported task")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("r.*"), rows.where("reason is not null").select("value", "reason")


def lookup_list(issues: DataFrame, names: DataFrame) -> DataFrame:
    """issue, names in order, missing: the comma list of ids in ``issues`` (issue, ids)
    looked up in ``names`` (id, name)."""
    ids = issues.select("issue", F.posexplode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "id"))
    joined = ids.join(names.select(F.col("id").cast("string").alias("id"), "name"), "id", "left")
    found = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return joined.groupBy("issue").agg(F.array_join(found, ",").alias("names"), F.count_if(F.col("name").isNull()).alias("missing"))


def overwrite_days(df: DataFrame, path: str, column: str = "report_date") -> None:
    """Replaces exactly the days that ``df`` holds; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A result as a Markdown table of at most ``limit`` rows, for readers; a last line
    says so if there are more. ``write_report`` keeps all rows."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    shown = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:limit]]
    return "\n".join([head, *shown, *([f"\nThe first {limit} rows; there are more."] if len(rows) > limit else [])])


def write_report(df: DataFrame, path: str, title: str, limit: int = 100) -> None:
    """A report of a result: all rows as JSON lines under ``path``/rows, and a page for readers
    under ``path``/page, both by Spark and replacing an earlier report."""
    df.write.mode("overwrite").json(f"{path}/rows")
    page = f"# {title}\n\n{markdown_table(df, limit)}\n"
    df.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/page")


def schema_difference(left: T.StructType, right: T.StructType, prefix: str = "") -> list[str]:
    """Fields that only one schema has, or that differ in type, nested ones by path."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (left, right))
    out = []
    for name in sorted({*a, *b}):
        path = prefix + name
        if name not in b:
            out.append(f"- {path}")
        elif name not in a:
            out.append(f"+ {path}")
        elif isinstance(a[name], T.StructType) and isinstance(b[name], T.StructType):
            out += schema_difference(a[name], b[name], path + ".")
        elif a[name] != b[name]:
            out.append(f"~ {path}: {a[name].simpleString()} / {b[name].simpleString()}")
    return out


def _traces(snapshot: str | None) -> list[tuple[int, float]]:
    """(tokens, latency) of the outermost objects with a model or prompt name, at any depth."""
    found, left = [], [json.loads(snapshot) if snapshot else None]
    while left:
        value = left.pop()
        if not isinstance(value, dict):
            continue
        if "model" in value or "prompt_name" in value:
            usage = value.get("usage")
            found.append((int(usage.get("total_tokens") or 0) if isinstance(usage, dict) else 0, float(value.get("latency_ms") or 0)))
        else:
            left += value.values()
    return found


def trace_totals(checkpoints: DataFrame, last: int = 1000) -> DataFrame:
    """Calls, tokens and mean latency of the model traces in the newest checkpoints (id,
    snapshot JSON)."""
    newest = checkpoints.orderBy(F.col("id").desc()).limit(last).select(F.col("snapshot").cast("string"))

    def run(it):
        for b in it:
            rows = [t for x in b.column(0).to_pylist() for t in _traces(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["tokens", "latency"])

    traces = newest.mapInArrow(run, "tokens long, latency double")
    return traces.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("latency_ms"))
