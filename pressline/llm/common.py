"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD_PATTERN).findall

#: A word of the newer contracts: ASCII digits and small letters, and all that is not ASCII.
ASCII_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
find_ascii_words = re.compile(ASCII_WORD_PATTERN).findall
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """The named columns of each Arrow batch as Python lists."""
    for b in it:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode (tests, a laptop) a
    temporary folder may stand for it; a cluster without the setting is an error, as
    executors would each write to a disk of their own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor
    costs a re-read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_files(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are written and gone. It does
    so when the driver's memory is swept, Python's references first; a job of very many small
    shuffles would otherwise hold their files until that happens by itself."""
    gc.collect()
    spark._jvm.System.gc()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo; a null id counts as bucket of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lowered(text) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that for texts that are all ASCII, and sooner."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_words(text) -> Column:
    """The words of ``ASCII_WORD_PATTERN`` of a text, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lowered(text), F.lit(ASCII_WORD_PATTERN), F.lit(0))


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), k1, k2: 128 bits that tell rows of another id or text apart."""
    d, t = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(d, t).alias("k1"), F.xxhash64(t, d, F.lit(1)).alias("k2"))


def unfolded(df: DataFrame, times: str, step: int = 65536, number: str | None = None) -> DataFrame:
    """Each row as often as ``times`` says, in two steps, so that no array grows with it;
    ``number``, if given, is a column that counts a row's copies from 0."""
    blocks = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(step).cast("long"))))
    copies = blocks.withColumn(number or "_at", F.explode(F.sequence("_from", F.least(F.col("_from") + step - 1, F.col(times) - 1))))
    return copies.drop("_from", "_at", times)
