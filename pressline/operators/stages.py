"""A pipeline of stages whose results are kept, and only what changed is computed again.

Each stage is a table of (id, fingerprint, output). A row's fingerprint is the hash of
the stage's version, of the message fields that the stage reads and of the outputs of the stages before
it in the graph. A kept row is valid if its fingerprint is the one that holds now; so an
edit makes invalid what depends on it, along the graph, and nothing else: where a
stage gives the same output as before, what follows stays valid.

A stage's function sees only the rows that are to be computed. It is the costly part (a
model's answer, a translation); the bookkeeping is one join by id a stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.lineage import materialised


@dataclass(frozen=True)
class Stage:
    """``compute`` takes rows with id, the fields and a column for each stage in ``after``,
    and returns id and output (text). A null output of an earlier stage ends a row's way:
    later stages that need it do not see it. ``version`` makes all kept rows invalid when it changes."""

    name: str
    fields: tuple[str, ...]
    after: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]
    version: str = "1"


def in_order(stages: list[Stage]) -> list[Stage]:
    """The stages so that each comes after those it needs; an error for a ring or an unknown name."""
    done: list[Stage] = []
    names: set[str] = set()
    left = list(stages)
    while left:
        ready = [s for s in left if set(s.after) <= names]
        if not ready:
            raise ValueError(f"stages in a ring, or after unknown ones: {sorted(s.name for s in left)}")
        done += ready
        names |= {s.name for s in ready}
        left = [s for s in left if s.name not in names]
    return done


def fingerprint(stage: Stage) -> Column:
    """Of the version, the fields and the outputs before, told apart from each other and from null."""
    parts = [F.lit(f"{stage.name}:{stage.version}"), *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (*stage.fields, *stage.after))]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def run_stages(messages: DataFrame, stages: list[Stage], kept: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """name: the stage's table (id, fingerprint, output, computed) over ``messages`` (id
    and the fields; ids are unique). ``kept`` are tables of an earlier run; rows of messages
    that are gone go with them."""
    kept = kept or {}
    out: dict[str, DataFrame] = {}
    for s in in_order(stages):
        rows = messages.select("id", *s.fields)
        for name in s.after:
            rows = rows.join(out[name].where("output is not null").select("id", F.col("output").alias(name)), "id")
        rows = rows.withColumn("fingerprint", fingerprint(s))
        if s.name in kept:
            old = kept[s.name].select("id", "fingerprint", F.col("output").alias("_output"), F.lit(True).alias("_kept"))
            rows = materialised(rows.join(old, ["id", "fingerprint"], "left"))
            valid = rows.where("_kept").select("id", "fingerprint", F.col("_output").alias("output"), F.lit(False).alias("computed"))
            todo = rows.where("_kept is null").drop("_output", "_kept")
        else:
            valid, todo = None, materialised(rows)
        made = todo.select("id", "fingerprint").join(s.compute(todo.drop("fingerprint")).select("id", F.col("output").cast("string").alias("output")), "id", "left").select("id", "fingerprint", "output", F.lit(True).alias("computed"))
        out[s.name] = materialised(made if valid is None else valid.unionByName(made))
    return out


def recomputed(tables: dict[str, DataFrame]) -> DataFrame:
    """stage, computed, reused: how much of each stage a run did."""
    every = None
    for name, t in tables.items():
        row = t.groupBy(F.lit(name).alias("stage")).agg(F.sum(F.col("computed").cast("int")).alias("computed"), F.sum((~F.col("computed")).cast("int")).alias("reused"))
        every = row if every is None else every.unionByName(row)
    return every
