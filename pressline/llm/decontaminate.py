"""Benchmark decontamination by spaced-seed hashing.

A fixed mask picks some positions of a window of tokens and ignores the others,
so a window still hits after substitutions at ignored positions. Every window of
the test items and of the documents is hashed under each mask; equal hashes give
a diagonal on which both texts are aligned, and the overlap around the hit is
verified: the segment with the most equal tokens among those with at least four
equal tokens in five.

The four masks pick six of ten positions such that, however two substitutions fall
on twelve tokens, one mask at one of the three places still hits. Test items of 5 to
11 tokens have masks of their own length, of which one hits wherever a fifth of the
tokens is substituted; items of fewer than five tokens only match documents that
consist of the same tokens. The test side is sent to the tasks only if its token
count is under ``BROADCAST_TOKENS``; a larger one is joined by hash through Spark,
with the same results.

Defined cases: null and tokenless texts never match; texts of any length are compared
whole; repeated rows are reported once per (doc_id, item_id); ties between segments
go to the shortest, then the first; empty tables give an empty result; further columns
are ignored by ``contaminated`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, table

TOKEN = re.compile(r"[^\W_]+")
#: 1: the token at this position counts.
MASKS = ("1001110101", "1001101011", "1000011111", "1111010001")
#: Test items with fewer tokens than this have masks of their own.
SPAN = 12
#: Test items with fewer tokens than this match whole documents only.
SHORTEST = 5
#: Least overlap, in equal tokens (or four in five of the whole item, if fewer).
MIN_OVERLAP = 10
#: A mismatch costs as much as four matches earn: segments that score zero or more keep 80 % equal tokens.
MISMATCH = 4
BROADCAST_TOKENS = 2_000_000
#: Diagonals of one document and item that are verified in one row of the join's result.
DIAGONALS = 1 << 16
#: Size of the bit table that is sent to test seeds by, at most (64 MB), and items that a fetched document meets at a time.
TABLE_BITS, FETCHED = 29, 500

_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_matched", pa.int64()), ("first_token", pa.int64()), ("item_tokens", pa.int64())])
HIT_SCHEMA = "doc_id long, item_id long, n_tokens long, n_matched long, first_token long, item_tokens long"


class TokenHashes(dict):
    """64-bit hashes of tokens; forgets when it holds too many."""

    LIMIT = 500_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def seeds(tokens: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the hashes of all windows of its length."""
    out = []
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(n, len(mask) << 16 | int(mask, 2), np.uint64)  # differs by mask
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ tokens[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
        out.append(mix64(h))
    return out


def document_masks(n: int, lengths: list[int]) -> tuple[str, ...]:
    """Masks for a document of n tokens, given the lengths of the short test items."""
    return (*MASKS, *(m for k in lengths if k >= SHORTEST or k == n for m in item_masks(k)))


def least_equal(n: int) -> int:
    """Equal tokens of n that are four in five."""
    return -(-MISMATCH * n // (MISMATCH + 1))


def item_masks(n: int) -> tuple[str, ...]:
    """Masks for an item of n tokens. Those of a short item leave out the parts of a
    division, one or two at a time, so that each substitution it may bear is left out by one."""
    if n >= SPAN:
        return MASKS
    if n < SHORTEST:
        return ("1" * n,) if n else ()
    out = n - least_equal(n)
    parts = 4 if out > 1 else n if n < 7 else 3
    return tuple("".join("01"[i * parts // n not in gone] for i in range(n)) for gone in combinations(range(parts), out))


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(length, matches, first document token) of the best segment on a diagonal,
    where document token i stands against item token i - diagonal. For each end the
    earliest start with no higher score gives the longest segment with four equal
    tokens in five, and so the most equal ones."""
    a, b = max(diagonal, 0), min(len(doc), len(item) + diagonal)
    same = doc[a:b] == item[a - diagonal : b - diagonal]
    if np.count_nonzero(same) < min(MIN_OVERLAP, least_equal(len(item))):
        return 0, 0, a
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    equal = np.concatenate([[0], np.cumsum(same)])
    start = np.searchsorted(-np.minimum.accumulate(score), -score)
    matched = equal - equal[start]
    if not matched.any():
        return 0, 0, a
    end = np.flatnonzero(matched == matched.max())
    # different tokens at the ends add nothing
    first = np.searchsorted(equal, equal[start[end]], side="right") - 1
    last = np.searchsorted(equal, equal[end])
    at = int(np.argmin(last - first))
    return int(last[at] - first[at]), int(matched[end[at]]), a + int(first[at])


class TestSide:
    """Hash table of the test items' seeds."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]]):
        hashes = TokenHashes()
        self.tokens = [(i, t) for i, t in ((i, hashes.of(x)) for i, x in items) if len(t)]
        self.short = sorted({len(t) for _, t in self.tokens if len(t) < SPAN})
        rows = []
        for k, (_, t) in enumerate(self.tokens):
            own = item_masks(len(t))
            for h in seeds(t, own):
                rows.append((h, np.full(len(h), k, np.int64), np.arange(len(h))))
        cat = [np.concatenate(c) if rows else np.zeros(0, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        order = np.argsort(cat[0], kind="stable")
        self.h, self.item, self.pos = (c[order] for c in cat)
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.h)).bit_length() + 5)))
        self.bits = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bits[self.h >> self.shift] = True

    def hits(self, doc: np.ndarray) -> dict[int, list[int]]:
        """item number -> diagonals of all equal hashes."""
        found = []
        for h in seeds(doc, document_masks(len(doc), self.short)):
            at = np.flatnonzero(self.bits[h >> self.shift])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
            times = hi - lo
            if not times.any():
                continue
            row = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(np.stack([self.item[row], np.repeat(at, times) - self.pos[row]]))
        out: dict[int, list[int]] = {}
        if found:
            for k, d in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
                out.setdefault(k, []).append(d)
        return out


def verified(doc: np.ndarray, item: np.ndarray, diagonals) -> tuple[int, int, int] | None:
    """The best segment over the diagonals, if it is long enough."""
    best = max((overlap(doc, item, d) for d in sorted(diagonals)), key=lambda s: (s[1], -s[0], -s[2]))
    return best if best[1] >= min(MIN_OVERLAP, least_equal(len(item))) else None


_sides: dict[str, TestSide] = {}


def _side(name: str, items) -> TestSide:
    """The hash table of the test items, built once a worker."""
    if name not in _sides:
        _sides.clear()
        _sides[name] = TestSide(items.value)
    return _sides[name]


def _by_broadcast(docs: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(it):
        side, hashes = _side(name, sent), TokenHashes()
        for b in it:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = hashes.of(text)
                for k, diagonals in side.hits(doc).items():
                    item_id, item = side.tokens[k]
                    if found := verified(doc, item, diagonals):
                        rows.append((doc_id, item_id, *found, len(item)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_HIT))], schema=_HIT)

    return docs.mapInArrow(run, HIT_SCHEMA)


def _bit_table(seeded: DataFrame) -> np.ndarray:
    """One bit for each leading part of a hash that an item's seed has, packed: what the
    documents' seeds are tested by before they are shuffled. It has eight bits a seed or more,
    up to 2**TABLE_BITS (then more seeds pass, and none is lost); ranges of it are made by tasks."""
    n = seeded.count()
    bits = max(16, min(TABLE_BITS, n.bit_length() + 3))
    ranges = 1 << min(8, bits - 3)

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        part = np.zeros((1 << bits) // ranges, bool)
        part[(h >> np.uint64(64 - bits)) & np.uint64(len(part) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([np.packbits(part).tobytes()], pa.binary())})

    part = F.shiftrightunsigned("h", 64 - (ranges.bit_length() - 1)).cast("int")
    made = seeded.select("h").distinct().groupBy(part.alias("part")).applyInArrow(fill, "part int, bytes binary").collect()  # at most 2**TABLE_BITS bits
    table = np.zeros((ranges, (1 << bits) // ranges // 8), np.uint8)
    for r in made:
        table[r.part] = np.frombuffer(r.bytes, np.uint8)
    return table.ravel()


def _known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same through an equality join on the seed hashes, with the document's row key
    (row). Of a document's seeds those are shuffled that a bit table of the items' seeds
    knows. The hits are grouped by document, and each document is fetched once (once
    for every ``FETCHED`` items that it meets)."""
    seeded = "id long, row long, h long, pos long"
    lengths = [r[0] for r in items.select(F.explode(_short_lengths()(F.col("text"))).alias("n")).distinct().collect()]  # under SPAN rows

    def emit(of_item: bool, sent=None):
        def run(it):
            hashes = TokenHashes()
            for b in it:
                for i, row, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                    t = hashes.of(text)
                    for h in seeds(t, item_masks(len(t)) if of_item else document_masks(len(t), sorted(lengths))):
                        at = np.arange(len(h)) if sent is None else np.flatnonzero(_known(h, sent.value))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array([row] * len(at), pa.int64()), pa.array(h[at].view(np.int64)), pa.array(at)], names=["id", "row", "h", "pos"])

        return run

    keyed = lambda df: df.withColumn("row", F.xxhash64("id", "text")).select("id", "row", "text")
    d, t = keyed(docs.toDF("id", "text")), keyed(items.toDF("id", "text"))
    right = cut_lineage(t.mapInArrow(emit(True), seeded))
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(right))
    left = d.mapInArrow(emit(False, table), seeded)
    diagonal = F.col("d.pos") - F.col("t.pos")
    by = [F.col("d.id").alias("id"), F.col("d.row").alias("row"), F.col("t.id").alias("item_id"), F.col("t.row").alias("item_row"), F.floor(diagonal / DIAGONALS).alias("part")]
    hits = left.alias("d").join(right.alias("t"), "h").groupBy(*by).agg(F.collect_set(diagonal).alias("diagonals"))
    item_texts = t.dropDuplicates(["id", "row"]).select(F.col("id").alias("t_id"), F.col("row").alias("t_row"), F.col("text").alias("item_text"))
    met = hits.join(item_texts, F.col("item_id").eqNullSafe(F.col("t_id")) & (F.col("item_row") == F.col("t_row"))).select("id", "row", "item_id", "item_row", "item_text", "diagonals")
    turn = F.floor(F.row_number().over(Window.partitionBy("id", "row").orderBy("item_row")) / FETCHED)
    wanted = met.withColumn("turn", turn).groupBy("id", "row", "turn").agg(F.collect_list(F.struct("item_id", "item_text", "diagonals")).alias("items"))
    wanted = cut_lineage(wanted)
    texts = d.dropDuplicates(["id", "row"])
    joined = wanted.join(texts, (wanted.row == texts.row) & wanted.id.eqNullSafe(texts.id)).select(wanted.id, wanted.row, "text", "items")

    def check(it):
        hashes = TokenHashes()
        for b in it:
            rows = []
            for doc_id, row, text, found in zip(*(b.column(k).to_pylist() for k in range(4))):
                doc = hashes.of(text)
                for x in found:
                    item = hashes.of(x["item_text"])
                    if best := verified(doc, item, x["diagonals"]):
                        rows.append((doc_id, x["item_id"], *best, len(item), row))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * (len(_HIT) + 1))], names=[*_HIT.names, "row"])

    return joined.mapInArrow(check, HIT_SCHEMA + ", row long")


def _short_lengths():
    @F.pandas_udf("array<int>")
    def short(texts):
        n = texts.map(lambda x: len(TOKEN.findall((x or "").lower())))
        return n.map(lambda k: [k] if 0 < k < SPAN else [])

    return short


def test_side(benchmark: DataFrame, broadcast_tokens: int) -> tuple[DataFrame, list[tuple[int, str]] | None]:
    """The test items, and also as a list if they are small enough to be sent to the
    tasks (four characters a token are assumed)."""
    t = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = t.agg(F.sum(F.length("text"))).first()[0] or 0
    return t, [tuple(r) for r in t.collect()] if size <= 4 * broadcast_tokens else None


test_side.__test__ = False  # type: ignore[attr-defined]


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per document and test item that overlap: the best segment's length,
    equal tokens and first document token."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t, items = test_side(benchmark, broadcast_tokens)
    found = _by_join(d, t) if items is None else _by_broadcast(d, items)
    key = F.struct("n_matched", (-F.col("n_tokens")).alias("n"), (-F.col("first_token")).alias("f"))
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_tokens", "n_matched", "first_token", "item_tokens"), key).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """The documents that overlap no test item. With a test side that fits the tasks
    every row is judged where it is read; else the verdict is joined back by id and
    text, with the same rows."""
    t, items = test_side(benchmark, broadcast_tokens)
    if items is None:
        doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
        leaks = _by_join(docs.select(doc_id.alias("doc_id"), text.alias("text")), t).select(F.col("doc_id").alias("_leak"), F.col("row").alias("_row")).distinct()
        return docs.join(leaks, doc_id.eqNullSafe(leaks["_leak"]) & (F.xxhash64(doc_id, text) == leaks["_row"]), "left_anti")
    sent, name, at = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex, docs.columns.index("text")

    def run(it):
        side, hashes = _side(name, sent), TokenHashes()
        for b in it:
            keep = []
            for text in b.column(at).to_pylist():
                doc = hashes.of(text)
                keep.append(not any(verified(doc, side.tokens[k][1], ds) for k, ds in side.hits(doc).items()))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
