"""Entity lists: canonical types and names, deduplication, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import text as T
from pressline.functions import vocab as V

# Aliases of entity types, competitions, and the patterns of team suffixes and codes.
ALIASES = {"hero": "champion", "pro_player": "player", "professional_player": "player", "club": "team", "competition": "tournament", "event": "activity", "mode": "game_mode", "version": "patch"}
COMPETITIONS = ("worlds", "cblol", "lpl", "lck", "lec", "lcs", "lcp", "pcs", "vcs", "lla", "msi", "ewc")
TEAM_SUFFIX = r"(?:电子竞技俱乐部|电竞俱乐部|电子竞技战队|电竞战队|战队)$"
LATIN = r"(?i)(?<![a-z0-9])([a-z][a-z0-9]{1,15})(?![a-z0-9])"
HAN = r"[一-鿿]"


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def canonical_type(kind: Column) -> Column:
    k = F.lower(T.strip(F.coalesce(kind, F.lit("unknown"))))
    return F.coalesce(_table(ALIASES)[k], k)


def fold_width(x: Column) -> Column:
    """Full-width ASCII and the wide space to their plain forms, the part of compatibility
    folding that an expression can do; ``compatible_entities`` does the whole."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return T.strip(F.translate(x, wide, "".join(map(chr, range(0x21, 0x7F))) + " "))


def canonical_name(kind: Column, name: Column) -> Column:
    return T.let(fold_width(F.coalesce(name, F.lit(""))), lambda n: _canonical(kind, n))


def _canonical(kind: Column, n: Column) -> Column:
    low = F.lower(n)
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(1))
    code = F.lit(None).cast("string")
    for c in reversed(COMPETITIONS):
        code = F.when(low.rlike(f"(^|[^a-z]){c}($|[^a-z])"), c).otherwise(code)
    contest = F.when(code.isNotNull(), code).when(F.size(latin) == 1, F.get(latin, F.lit(0))).otherwise(n)
    short = T.strip(F.regexp_replace(n, TEAM_SUFFIX, ""))
    team_latin = F.regexp_extract_all(F.lower(short), F.lit(LATIN), F.lit(1))
    team = F.when((F.size(team_latin) > 0) & short.rlike(HAN), F.get(team_latin, F.lit(0))).otherwise(short)
    own = F.regexp_extract_all(n, F.lit(LATIN), F.lit(1))
    longest = F.aggregate(own, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    person = F.when((F.size(own) > 0) & n.rlike(HAN), longest).otherwise(n)
    return F.when(n == "", n).when(kind.isin("league", "tournament"), contest).when(kind == "team", team).when(kind.isin("player", "coach", "person"), person).otherwise(n)


def normalize_entities(entities: Column) -> Column:
    """array<struct<type,name,role>> with canonical types, names and ids; the first of
    each (type, key) stays, empty keys go. ``compatible_entities`` comes before."""

    def one(e):
        kind = canonical_type(e["type"])
        name = canonical_name(kind, e["name"])
        role = F.lower(F.coalesce(e["role"], F.lit("context")))
        return F.struct(
            kind.alias("type"), F.coalesce(e["name"], F.lit("")).alias("display_name"), name.alias("canonical_name"), F.concat(kind, F.lit(":"), T.key_token(name)).alias("canonical_id"),
            F.when(role.isin("core", "context", "affected"), role).otherwise("context").alias("role"),
        )

    rows = F.filter(F.transform(entities, one), lambda e: ~e["canonical_id"].endswith(":"))
    ids = F.transform(rows, lambda e: e["canonical_id"])
    return F.filter(rows, lambda e, i: F.array_position(ids, e["canonical_id"]) == i + 1)


def compatible_entities(rows: DataFrame, column: str = "entities") -> DataFrame:
    """``rows`` with the names of an entity column in their compatible form (NFKC), so that
    ligatures, full-width and half-width forms of a name are one name."""
    composed = rows.withColumn("_names", T.compatible(F.transform(column, lambda e: e["name"])))
    return composed.withColumn(column, F.transform(column, lambda e, i: e.withField("name", F.get(F.col("_names"), i)))).drop("_names")


def anchors(entities: Column) -> Column:
    """map of anchor key -> distinct ids, in order of appearance."""
    table = _table(V.ENTITY_ANCHORS)
    kept = F.filter(entities, lambda e: table[e["type"]].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda e: table[e["type"]]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_distinct(F.transform(F.filter(kept, lambda e: table[e["type"]] == k), lambda e: e["canonical_id"]))))
