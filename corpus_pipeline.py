"""A training corpus in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the next
one reads what it wrote. All but the last return the columns of ``documents``; the
last adds how often the mix takes a document. Nulls, empty and very long texts, ties,
repeated rows, empty tables and further columns, whatever their names, are treated as
the operators' docstrings say; a column named copies is replaced by the mix's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from pressline.llm.common import remove_folder, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy."""
    return quality_rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often (copies, which replaces a column
    of that name)."""
    own = [F.col("document")[c].alias(c) for c in docs.columns if c.lower() != "copies"]
    return mixing.mix(docs).where("copies > 0").select(*own, "copies")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: Not expressible in SQL: fingerprints, spaced seeds and the randomness battery.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder of
    spark.checkpoint.dir (a temporary one only in local mode) and read again. A result
    is removed when the next one is written; the last stays."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
