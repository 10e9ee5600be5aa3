"""Deletes that cascade along foreign keys, and updates from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.lineage import materialised

Reference = tuple[str, str, str]


def cascade(tables: dict[str, DataFrame], references: list[Reference], start: dict[str, DataFrame]) -> DataFrame:
    """table, id, round: every row that goes when the rows of ``start`` (name: frame with
    id) go. ``tables`` have an id; a reference (child, column, parent) says that the child's
    column holds ids of the parent. Tables may refer to themselves and to each other in rings.

    Rounds: the rows that point at what the last round found, less those known, until
    none is new. Each round joins the child's two columns with that round's keys alone,
    so a row is joined once for each reference, whatever the depth."""
    if unknown := {n for c, _, p in references for n in (c, p)} | set(start) - set(tables):
        if unknown - set(tables):
            raise ValueError(f"no table for {sorted(unknown - set(tables))}")
    kind = lambda df, name: df.select(F.lit(name).alias("table"), F.col("id").cast("long").alias("id"))
    first = None
    for name, keys in start.items():
        rows = kind(tables[name].join(keys.select("id").distinct(), "id", "left_semi"), name)
        first = rows if first is None else first.unionByName(rows)
    fresh = materialised(first.distinct().withColumn("round", F.lit(0)))
    found, n = fresh, 0
    while not fresh.isEmpty():
        n += 1
        reached = None
        for child, column, parent in references:
            keys = fresh.where(F.col("table") == parent).select(F.col("id").alias(column))
            rows = kind(tables[child].select("id", column).join(keys, column, "left_semi"), child)
            reached = rows if reached is None else reached.unionByName(rows)
        if reached is None:
            break
        fresh = materialised(reached.distinct().join(found.select("table", "id"), ["table", "id"], "left_anti").withColumn("round", F.lit(n)))
        found = found.unionByName(fresh)
    return found


def delete_cascading(tables: dict[str, DataFrame], references: list[Reference], start: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows that go, and those (table, id, round)."""
    gone = cascade(tables, references, start)
    left = {name: df.join(gone.where(F.col("table") == name).select("id"), "id", "left_anti") for name, df in tables.items()}
    return left, gone


def update_from(target: DataFrame, source: DataFrame, on: list[str], assign: dict[str, Column], order: list[Column], where: Column | None = None, insert: bool = False) -> DataFrame:
    """``target`` with the columns of ``assign`` set in rows that ``source`` matches on the
    keys; other columns and rows stay as they are. Expressions name target columns as t.x and
    source columns as s.x. Of several source rows of a key the first in ``order`` (ties:
    by all columns) wins, so that the result does not depend on the order of rows. ``where``
    restricts the matches. With ``insert``, keys without a row in the target are added,
    with the assigned columns; those may then use s alone.

    One shuffle of each side by the keys: the winner is chosen where the join meets it."""
    rank = Window.partitionBy(*on).orderBy(*order, *(F.col(c) for c in source.columns if c not in on))
    one = source.withColumn("_place", F.row_number().over(rank)).where("_place = 1").drop("_place")
    if where is not None and insert:
        raise ValueError("a restricted update cannot tell which keys to insert")
    t, s = target.alias("t"), one.withColumn("_matched", F.lit(True)).alias("s")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"t.{c}") == F.col(f"s.{c}"))
    hit = F.coalesce(F.col("s._matched") & (where if where is not None else F.lit(True)), F.lit(False))
    columns = [F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c) for c in target.columns]
    updated = t.join(s, same, "left").select(*columns)
    if not insert:
        return updated
    unmatched = one.alias("s").join(target.select(*on).distinct().alias("k"), on, "left_anti")
    types = {f.name: f.dataType for f in target.schema.fields}
    added = unmatched.alias("s").select(*((F.col(f"s.{c}") if c in on else assign[c] if c in assign else F.lit(None)).cast(types[c]).alias(c) for c in target.columns))
    return updated.unionByName(added)
