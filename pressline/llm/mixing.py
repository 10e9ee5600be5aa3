"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. A source's target
is first covered by whole passes over it; of the rest, all but a few lengths of the
longest document is taken as the same share of every length, and what then remains is
solved as a bounded knapsack over the leftover counts. If the target is missed, the
same is tried with one pass less and documents that may repeat. The plan says how many
documents of each length to take; which ones is decided by a seeded hash order.

Only counts by (source, length) are ever grouped: one row per distinct length; targets
are made over one row per source. The documents of a length lie in buckets by hash: whole
buckets are taken where the documents are read, and only the one bucket in which the
plan's number ends is ranked, so that hardly any text is shuffled. The plan is sent to
the tasks if it has at most ``SENT_ROWS`` rows and joined by shuffle else. The knapsack holds four
bytes for each sum up to ``SLACK`` + 1 lengths of a source's longest document.

Defined cases: a null text has length 0; a null source is a source of its own,
ordered last; documents of length 0 are taken as often as their source is passed
through whole; a very long document is a document like any other; repeated rows are
separate documents, and rows of equal id, length and text are interchangeable; an
empty table gives an empty result; further input columns, whatever their names, are
kept inside ``document`` by ``mix`` and ignored by the query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut_lineage, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
SEED = 20240101
#: Hash buckets that share the documents of one source and length.
BUCKETS = 256
#: Rows of the plan, one for each source and length, up to which it is sent to every task.
SENT_ROWS = 200_000
#: The knapsack's budget, in lengths of the longest document.
SLACK = 2


def targets(totals: DataFrame) -> DataFrame:
    """source, source_size -> target: shares by weight of the sum of all sizes, at
    most MAX_PASSES times the source, the excess going to the others by weight.
    Solved in closed form: sources ordered by cap over weight fill up first. The
    windows see one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(MAX_PASSES)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    t = t.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    t = t.withColumn("common", F.min_by("level", F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(every))
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight")))).select("source", "source_size", "target")


def _set_bits(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    some = np.flatnonzero(raw)
    at, bit = np.nonzero(np.unpackbits(raw[some, None], axis=1, bitorder="little"))
    return some[at] * 8 + bit


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the sum comes nearest to
    ``budget`` (of two equally near ones, to the lower): bounded-knapsack dynamic
    programming over the set of reachable sums, kept as the bits of an integer. For
    each sum the step is noted that reached it first, which is all that the way back
    needs. Sums are counted in the lengths' common divisor."""
    taken = [0] * len(lengths)
    usable = [i for i, (length, count) in enumerate(zip(lengths, counts)) if length and count]
    if budget <= 0 or not usable:
        return taken
    unit = math.gcd(*(lengths[i] for i in usable))
    low, over = divmod(budget, unit)
    ideal = low + (2 * over > unit)  # the multiple of the unit that is nearest to the budget
    top = low + max(lengths[i] for i in usable) // unit
    limit = (1 << (top + 1)) - 1
    first = np.full(top + 1, -1, np.int32)
    reach, steps = 1, []
    for i in usable:
        length = lengths[i] // unit
        left, chunk = min(counts[i], top // length), 1
        while left and not reach >> ideal & 1:
            n = min(chunk, left)
            new = (reach << (n * length)) & limit & ~reach
            if new:
                first[_set_bits(new)] = len(steps)
                steps.append((i, n))
                reach |= new
            left -= n
            chunk *= 2
        if reach >> ideal & 1:
            break
    at = (reach & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = reach >> (low + 1)
    if above:
        higher = low + (above & -above).bit_length()  # the lowest reachable sum above
        if higher * unit - budget < budget - at * unit:
            at = higher
    while at:
        i, n = steps[first[at]]
        taken[i] += n
        at -= n * lengths[i] // unit
    return taken


def plan_source(lengths: list[int], counts: list[int], target: float) -> tuple[list[int], list[int]]:
    """For each length: whole passes over its documents, and how many are taken once more."""
    total = sum(a * b for a, b in zip(lengths, counts))
    none = [0] * len(lengths)
    if total == 0:
        return none, none
    passes = min(MAX_PASSES, int((target + 0.5) // total))
    rest = round(target) - passes * total
    if passes == MAX_PASSES or rest <= 0:
        return [passes] * len(lengths), none
    extra = _spread(lengths, counts, rest)
    missed = abs(rest - sum(a * e for a, e in zip(lengths, extra)))
    if missed and passes:
        # it may come nearer if a pass is given up and documents repeat instead
        again = _spread(lengths, [2 * n for n in counts], rest + total)
        if abs(rest + total - sum(a * e for a, e in zip(lengths, again))) < missed:
            passes, extra = passes - 1, again
    return [passes + (e // n if n else 0) for e, n in zip(extra, counts)], [e % n if n else 0 for e, n in zip(extra, counts)]


def _spread(lengths: list[int], counts: list[int], rest: int) -> list[int]:
    """The same share of every length for what is beyond the slack, then the longest
    documents down to the slack, then the knapsack."""
    total = sum(a * b for a, b in zip(lengths, counts))
    slack = SLACK * max(lengths)
    extra = [n * max(0, rest - slack) // total for n in counts]
    left = [n - e for n, e in zip(counts, extra)]
    rest -= sum(a * e for a, e in zip(lengths, extra))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if lengths[i] and rest > slack:
            n = min(left[i], (rest - slack) // lengths[i])
            extra[i] += n
            left[i] -= n
            rest -= n * lengths[i]
    order.reverse()
    for i, n in zip(order, fit([lengths[i] for i in order], [left[i] for i in order], rest)):
        extra[i] += n
    return extra


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    passes, extra = plan_source(pdf["size"].tolist(), pdf["n"].tolist(), float(pdf["target"].iloc[0]))
    return pdf.assign(passes=passes, extra=extra)[["source", "size", "source_size", "target", "passes", "extra"]]


def mix(docs: DataFrame) -> DataFrame:
    """document (the row as a struct), size, source_size, target and copies (how often
    the mix has the document)."""
    sized = docs.select(
        F.struct("*").alias("document"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("order"),
    ).withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(BUCKETS)))
    counts = cut_lineage(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(totals)
    planned = (
        by_size.join(goal, by_size.source.eqNullSafe(goal.source)).select(by_size.source, "size", "n", "source_size", "target")
        .groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, passes long, extra long")
    )
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    p, o, d = planned.alias("p"), offsets.alias("o"), sized.alias("d")
    # the bucket in which the number of documents taken once more is reached
    ends = (F.col("skip") < F.col("extra")) & (F.col("extra") <= F.col("skip") + F.col("n"))
    plan = p.join(o, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.size") == F.col("o.size")) & ends, "left").select(
        "p.source", "p.size", "source_size", "target", "passes",
        F.coalesce("bucket", F.lit(-1)).alias("edge"), F.coalesce(F.col("extra") - F.col("skip"), F.lit(0)).alias("quota"),
    )
    plan = cut_lineage(plan)
    q = (F.broadcast(plan) if plan.count() <= SENT_ROWS else plan).alias("q")
    # null-safe comparisons, as Spark would else count the words a second time to drop nulls
    joined = d.join(q, F.col("d.source").eqNullSafe(F.col("q.source")) & F.col("d.size").eqNullSafe(F.col("q.size")))
    at_edge = F.col("bucket").eqNullSafe(F.col("edge"))
    kept = ["document", F.col("q.size").alias("size"), "source_size", "target"]
    decided = joined.where(~at_edge).select(*kept, (F.col("passes") + (F.col("bucket") < F.col("edge")).cast("int")).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("q.source", "q.size").orderBy("order", F.col("document")["doc_id"]))
    ranked = joined.where(at_edge).select(*kept, (F.col("passes") + (rank <= F.col("quota")).cast("int")).alias("copies"))
    return decided.unionByName(ranked)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("document.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
