"""Importance resampling towards a target distribution.

Runs of one to ``NGRAMS`` words are hashed into ``BUCKETS`` buckets. A bucket's gain is the logarithm
of how much more often it occurs in the target's texts than in the corpus, in steps of
1/1000; a document's weight is the sum of the gains of its runs. Seeded Gumbel noise on
the weight turns drawing without replacement into taking the highest scores.

How it runs: the gains are one array of fixed size, sent to all tasks, by which every
text is scored where it is read (texts are never shuffled). Scores are integers, so a
histogram of them is exact. It is cut into ranges of scores at quantiles; the counts of
the ranges (at most ``RANGES`` numbers) go to the driver and are summed from the top;
inside its range every score adds the counts above it. So each score knows how many
documents lie above it, and the scores whose offset is below the number to draw survive:
the last of them is the cutoff. Only the surviving rows are joined with their score's
offset and numbered by doc_id inside it. Rows of equal score, id, weight and features
are one row with a count until then, so that a row repeated a million times is no hot key;
rows that differ in their ids are spread over many scores by the noise.

Defined cases: a null or empty text has no features and weight 0; a very long text is
scored whole in one task; a null doc_id counts as the empty text in the seed and comes
last among ties; among equal scores and ids the one with fewer features comes first, equal
rows share the next ranks among them; an empty table gives an empty result, an empty
target equal gains by frequency alone; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD_PATTERN, LOWER, UPPER, ascii_lower, cut_lineage, find_ascii_words, table, unfolded

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Ranges of scores in which the histogram is summed.
RANGES = 512
#: Words whose bucket a task remembers.
REMEMBERED = 500_000

class Buckets(dict):
    """Bucket of each run of words, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        b = self[run] = zlib.crc32(run.encode("utf-8", "surrogatepass")) % self.buckets
        return b


def features(text: str | None, ngrams: int, cache: Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to ``ngrams`` words."""
    words = find_ascii_words(ascii_lower(text)) if text else []
    runs = words if ngrams == 1 else [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(cache.__getitem__, runs), np.int64, len(runs))


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """Features of all texts (column text) by bucket: each task sends its sums once."""

    def run(it):
        total, cache = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in it:
            for text in b.column(0).to_pylist():
                total += np.bincount(features(text, ngrams, cache)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln) of its smoothed share in the target over that in the corpus."""
    b = float(len(corpus))
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, ngrams: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(it):
        array, cache = sent.value, Buckets(len(sent.value))
        for b in it:
            rows = []
            for text in b.column(1).to_pylist():
                n_words, found = features(text, ngrams, cache)
                rows.append((n_words, len(found), int(array[found].sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_noise(rows: DataFrame, seed: int) -> DataFrame:
    """Adds score: the weight plus Gumbel noise that the seed and the id fix."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def score_offsets(folded: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """score, above (documents with a higher score), and the number of documents; ``folded``
    has score and times."""
    histogram = cut_lineage(folded.groupBy("score").agg(F.sum("times").alias("n")))
    edges = histogram.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    if not edges:
        return histogram.select("score", F.lit(0).cast("long").alias("above")), 0
    edges = F.lit(sorted(set(edges)))
    ranged = histogram.withColumn("range", F.size(F.filter(edges, lambda e: e < F.col("score"))))
    sums, total = [], 0
    for r in sorted(ranged.groupBy("range").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.range):  # at most one row a range
        sums.append((r.range, total))
        total += r.n
    over = F.map_from_arrays(F.lit([r for r, _ in sums]), F.lit([n for _, n in sums]).cast("array<bigint>"))
    higher = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(higher), F.lit(0))
    return ranged.select("score", (F.element_at(over, F.col("range")) + inside).alias("above")), total


def resample(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = with_noise(weighed(docs, gain, ngrams), seed)
    rows = cut_lineage(scored.groupBy("score", "doc_id", "n_features", "weight", (F.col("n_words") >= min_words).alias("fit")).agg(F.count("*").alias("times")))
    fit = rows.where("fit")
    offsets, total = score_offsets(fit, ranges)
    drawn = percent * total // 100
    surviving = cut_lineage(offsets.where(F.col("above") < drawn))
    out = ["doc_id", "n_features", "weight", "score"]
    cutoff = surviving.agg(F.min("score")).first()[0]
    if cutoff is None:
        return unfolded(rows.select(*out, "times"), "times").withColumn("rank", F.lit(None).cast("long"))
    before = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    top = fit.where(F.col("score") >= cutoff).join(surviving, "score").withColumn("place", F.col("above") + F.coalesce(F.sum("times").over(before), F.lit(0)))
    numbered = unfolded(top.select(*out, "place", "times"), "times", number="copy")
    rank = F.col("place") + F.col("copy") + 1
    ranked = numbered.select(*out, F.when(rank <= drawn, rank).alias("rank"))
    rest = rows.where(~F.col("fit") | (F.col("score") < cutoff)).select(*out, "times")
    return ranked.unionByName(unfolded(rest, "times").withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(hex(encode(w))) // 2 + 1), lambda b: ('0x' || substr(hex(encode(w)), 2 * b - 1, 2))::ubigint)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"""

OP13_SQL = rf"""
with doc as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ASCII_WORD_PATTERN}') as ws from documents),
target as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ASCII_WORD_PATTERN}')) as w from benchmark),
word as (select rid, unnest(ws) as w from doc),
bucket as (select w, ({_CRC} % {BUCKETS})::bigint as bucket from (select w from word union select w from target)),
corpus as (select bucket, count(*) as s from word join bucket using (w) group by bucket),
wanted as (select bucket, count(*) as t from target join bucket using (w) group by bucket),
gain as (
    select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select sum(s) from corpus)::double + {BUCKETS}) / ((coalesce(s, 0)::double + 1) * (coalesce((select sum(t) from wanted), 0)::double + {BUCKETS}))))::bigint as gain
    from corpus full join wanted using (bucket)),
weight as (select rid, sum(gain)::bigint as weight from word join bucket using (w) join gain using (bucket) group by rid),
noisy as (
    select rid, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from doc left join weight using (rid)),
placed as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as place, count(*) over () as n from noisy where n_features >= {MIN_WORDS})
select doc_id, n_features, weight, score, case when place <= {PERCENT} * n // 100 then place end as rank from noisy left join placed using (rid)
"""
