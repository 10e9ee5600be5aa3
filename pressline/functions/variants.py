"""JSON whose shape is not known, as VARIANT: paths, key whitelists and leaves at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.lineage import materialised
from pressline.functions.text import strip


def text_at(v: Column, path: str) -> Column:
    """The value at a path as text; null where it is missing, null or no scalar."""
    return F.try_variant_get(v, path, "string")


def string_at(v: Column, path: str) -> Column:
    """The value at a path if it is a JSON string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def items_at(v: Column, path: str) -> Column:
    """The members of the array at a path; none where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def only(v: Column, keys: tuple[str, ...]) -> Column:
    """An object with the named keys alone; null for anything else."""
    return F.to_variant_object(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k.isin(*keys)))


def without(v: Column, keys: tuple[str, ...]) -> Column:
    """An object without the named keys; null for anything else."""
    return F.to_variant_object(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*keys)))


def _members(v: Column) -> Column:
    """Members of an array in order, or of an object by name; null for scalars."""
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.transform(F.array_sort(F.transform(fields, lambda e: e["key"])), lambda k: F.get(F.filter(fields, lambda e: e["key"] == k), F.lit(0))["value"])
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), named)


def leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path (places from the root down: position in an array, place by name in an
    object), value (text): the scalars of a VARIANT column at any depth, but for JSON nulls.

    Works in rounds: each opens the containers that the last one found, until none is left,
    so that depth is bounded by the data alone. Rounds are cut off from one another."""
    open_ = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.col(column).alias("v"))
    found = []
    while True:
        opened = open_.withColumn("members", _members(F.col("v")))
        scalar = F.variant_get("v", "$", "string")
        found.append(opened.where("members is null").select("key", "path", F.schema_of_variant("v").alias("kind"), scalar.alias("value")))
        inner = opened.where("size(members) > 0").select("key", "path", F.posexplode("members").alias("place", "v"))
        open_ = materialised(inner.select("key", F.concat("path", F.array("place")).alias("path"), "v"))
        if open_.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.where("value is not null").withColumnRenamed("key", key)


def leaf_texts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, texts: the distinct lower-cased, trimmed leaves of each row in the order of
    their first place. Empty texts, zeros and false say nothing and are left out."""
    zero = ~F.col("kind").isin("STRING", "BOOLEAN") & (F.expr("try_cast(value as double)") == 0)
    said = leaves(rows, key, column).where(~F.coalesce(zero, F.lit(False)) & ~((F.col("kind") == "BOOLEAN") & (F.col("value") == "false")))
    texts = said.select(key, "path", F.lower(strip(F.col("value"))).alias("text")).where("text <> ''")
    first = texts.groupBy(key, "text").agg(F.min("path").alias("path"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]).alias("texts"))
