"""Order-dependent packing of blocks, as folds over one message's array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BLOCKS, CHUNK_CHARS, BLOCK_OVERHEAD = 40, 6000, 80


def chunk_numbers(texts: Column, blocks: int = CHUNK_BLOCKS, chars: int = CHUNK_CHARS) -> Column:
    """Chunk number of each text: a chunk closes when it is full by count or by characters."""
    start = F.expr("named_struct('n', 0, 'c', 0, 'k', 0, 'out', cast(array() as array<int>))")

    def step(a, t):
        size = F.length(t) + BLOCK_OVERHEAD
        full = (a["n"] > 0) & ((a["n"] >= blocks) | (a["c"] + size > chars))
        k = F.when(full, a["k"] + 1).otherwise(a["k"])
        return F.struct(F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, size).otherwise(a["c"] + size).alias("c"), k.alias("k"), F.concat(a["out"], F.array(k)).alias("out"))

    return F.aggregate(texts, start, step, lambda a: a["out"])


def pick_within(texts: Column, terms: Column, limit: int = 24_000) -> Column:
    """The texts that name most terms, within a budget of characters, back in order. A
    message within the budget is returned whole by the caller; this is for longer ones."""
    scored = F.transform(texts, lambda t, i: F.struct((-F.size(F.filter(terms, lambda w: F.lower(t).contains(w)))).alias("s"), i.alias("i"), F.trim(t).alias("t")))
    start = F.expr("named_struct('used', 0, 'kept', cast(array() as array<struct<i:int,t:string>>))")

    def step(a, x):
        room = F.lit(limit) - a["used"]
        cut = F.substr(x["t"], F.lit(1), F.greatest(room, F.lit(0)))
        taken = F.struct((a["used"] + F.length(cut) + 1).alias("used"), F.concat(a["kept"], F.array(F.struct(x["i"].alias("i"), cut.alias("t")))).alias("kept"))
        return F.when((room > 0) & (x["t"] != ""), taken).otherwise(a)

    kept = F.aggregate(F.array_sort(scored), start, step)["kept"]
    return F.substring(F.array_join(F.transform(F.array_sort(kept), lambda x: x["t"]), "\n"), 1, limit)


#: Words of errors that another try does not mend, and below those that tell a collection failure (fixed values).
PERMANENT = ("no longer exists", "has been superseded", "manual processing run owns", "no longer available", "configuration", "unsupported")


def is_retryable(kind: Column, message: Column) -> Column:
    """Whether a processing error may be tried again."""
    found = F.lit(False)
    for m in PERMANENT:
        found = found | F.lower(message).contains(m)
    return (kind != "lookup") & ~found


def collection_error(connector: Column, kind: Column, message: Column) -> Column:
    """Class of a collection failure from the connector, the error's kind and its message."""
    m = F.lower(message)
    any_of = lambda *xs: F.greatest(*(m.contains(x).cast("int") for x in xs), F.lit(0)) == 1
    configuration = kind == "configuration"
    return (
        F.when(configuration & (connector == "x_twitter"), F.when(any_of("cookie", "auth", "login", "ct0", "token"), "authentication").otherwise("configuration"))
        .when(configuration & (connector == "weibo"), F.when(any_of("login", "profile", "cookie", "登录"), "authentication").otherwise("configuration"))
        .when(configuration & (connector == "baidu_tieba"), "configuration")
        .when(connector == "x_twitter", F.when(any_of("rate-limited", "rate limited"), "rate_limited").when(any_of("blocked", "rejected"), "upstream_rejected").otherwise("collection_failed"))
        .when((connector == "weibo") & any_of("reject", "登录"), "upstream_rejected").otherwise("collection_failed")
    )
