"""Language-model scoring by deleted interpolation.

An n-gram's probability is a mixture of maximum-likelihood estimates of every
order and the uniform distribution. The weights depend on how often the context
was seen: the longest seen context and the logarithm of its count make a bucket, and
each bucket's weights are learned by expectation-maximisation on held-out counts, a
tenth of the training documents against the counts of the others. The final
estimates use the counts of all training documents, but for those of the document that
is scored: a training document is scored as if it were held out, so that scores compare
and a text that occurs again elsewhere stands out.

How it runs: documents are packed into blocks; each block sends its distinct
n-gram hashes with their counts, sorted, to the shard that owns them; a shard adds
up what all blocks send and answers each block in the order it asked, so the way
back carries counts alone. An n-gram that fills the corpus costs one entry a block.
Beyond ``FAN_IN`` blocks the exchange has two levels: groups of blocks are merged
first, and only merged lists go to the shards, so that a row always holds hundreds of
n-grams. Only a histogram of bounded size (estimates and buckets, in steps, with the
mean estimates of each cell) reaches the driver for the weights.

Defined cases: a null text is empty, its one token is the end; a very long text is a
block of its own; repeated rows are scored and learned row by row; a null doc_id counts
as the empty text for the split; without training documents every estimate falls back
to the uniform one; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut_lineage, find_words, mix64, table

ORDER = 2
TEST_OF, TEST_IS, TUNE_IS = 10, 0, 9
ALPHA = 0.1
#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 6_000_000
#: n-gram entries that a shard should get.
SHARD_ENTRIES = 1_500_000
#: Blocks, or merged groups of blocks, that one shard hears.
FAN_IN = 4096
#: Steps of the logarithm of a context's count.
BUCKETS = 24
#: Levels of an estimate in the histogram for the weights: zero, and powers of two.
LEVELS = 32
ROUNDS = 60
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
KINDS = ("test", "train", "tune")


class WordHashes(dict):
    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


def token_hashes(texts: list[str], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token, and where texts start."""
    parts, sizes = [], []
    end = np.array([END])
    for x in texts:
        words = find_words(ascii_lower(x))
        parts += [np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), end]
        sizes.append(len(words) + 1)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(parts), starts


def gram_hashes(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """By order 1.., the hash of the n-gram that ends at each token, padded at the start of a text."""
    at = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    out = [mix64(tokens)]
    for k in range(1, order):
        before = np.full(len(tokens), START)
        before[k:] = tokens[:-k]
        before[at < k] = START
        out.append(mix64((out[-1] ^ before) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
    return out


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; sorted hashes are passed as differences."""
    v = np.ascontiguousarray(values, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_hashes(h: np.ndarray) -> bytes:
    return _pack(np.diff(h, prepend=np.uint64(0)))


def unpack_hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


def kind_of(doc_id) -> int:
    r = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % TEST_OF
    return 0 if r == TEST_IS else 2 if r == TUNE_IS else 1


BLOCK_SCHEMA = "block string, kind int, ids array<long>, size long, tokens binary"


def pack_tokens(texts: list[str], cache: WordHashes) -> tuple[int, bytes]:
    """Number of tokens, and the tokens of a block as its vocabulary of hashes and places in it, compressed."""
    tokens, starts = token_hashes(texts, cache)
    words, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # frequent words have low places, which compress well
    place = np.empty(len(words), "<u4")
    place[order] = np.arange(len(words))
    words, at = words[order], place[at]
    planes = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
    raw = b"".join([np.array([len(starts), len(words), len(at)], "<i8").tobytes(), starts.astype("<i8").tobytes(), words.astype("<u8").tobytes(), planes.tobytes()])
    return len(tokens), zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_tokens(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As ``token_hashes``: hashes of all tokens, and where texts start."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n_starts, n_words, n = np.frombuffer(raw, "<i8", 3).tolist()
    starts = np.frombuffer(raw, "<i8", n_starts, 24)
    words = np.frombuffer(raw, "<u8", n_words, 24 + 8 * n_starts)
    planes = np.frombuffer(raw, np.uint8, 4 * n, 24 + 8 * (n_starts + n_words))
    return words[np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()], starts


def blocks(docs: DataFrame) -> DataFrame:
    """Documents packed by kind, so that the held-out parts can be read alone; texts are
    cut into tokens here, once."""
    schema = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("size", pa.int64()), ("tokens", pa.binary())])

    def run(it):
        import os

        held: list[tuple[list, list[str], int]] = [([], [], 0) for _ in KINDS]
        cache = WordHashes()

        def row(kind):
            ids, texts, _ = held[kind]
            held[kind] = ([], [], 0)
            n, blob = pack_tokens(texts, cache)
            return pa.RecordBatch.from_arrays([pa.array([os.urandom(12).hex()]), pa.array([kind], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([n]), pa.array([blob])], schema=schema)

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = kind_of(doc_id)
                ids, texts, size = held[k]
                text = text or ""
                if ids and size + len(text) > BLOCK_CHARS:
                    yield row(k)
                    ids, texts, size = held[k]
                ids.append(doc_id)
                texts.append(text)
                held[k] = (ids, texts, size + len(text))
        for k, (ids, _, _) in enumerate(held):
            if ids:
                yield row(k)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _shard_cuts(shards: int) -> np.ndarray:
    """Lower ends of equal ranges of the hash, but for the first."""
    return (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)


def requests(packed: DataFrame, order: int, shards: int) -> DataFrame:
    """block, kind, shard, n (order), hashes, counts: the distinct n-grams of each block."""
    names = ["block", "kind", "shard", "n", "hashes", "counts"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(it):
        cuts = _shard_cuts(shards)
        for b in it:
            for block, kind, blob in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
                tokens, starts = unpack_tokens(blob)
                rows = []
                for n, h in enumerate(gram_hashes(tokens, starts, order), 1):
                    u, c = np.unique(h, return_counts=True)
                    ends = np.concatenate([[0], np.searchsorted(u, cuts), [len(u)]])
                    rows += [(block, kind, s, n, pack_hashes(u[a:e]), _pack(c[a:e])) for s, (a, e) in enumerate(zip(ends[:-1], ends[1:])) if e > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return packed.mapInArrow(run, "block string, kind int, shard int, n int, hashes binary, counts binary")


ANSWERS = "block string, kind int, shard int, n int, counts binary, main binary, totals array<long>"


def _merged(tables: pa.Table):
    """All requests of one shard and order: the distinct hashes, their counts in the
    training documents, in those without the tuning part, and each request's places."""
    asked = [unpack_hashes(x) for x in tables.column("hashes").to_pylist()]
    every = np.unique(np.concatenate(asked))
    all_, main = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
    places = []
    for kind, h, c in zip(tables.column("kind").to_pylist(), asked, tables.column("counts").to_pylist()):
        at = np.searchsorted(every, h)
        places.append(at)
        if kind:
            c = _unpack(c)
            all_[at] += c
            if kind == 1:
                main[at] += c
    return every, all_, main, places


def _totals(all_: np.ndarray, main: np.ndarray, n: int) -> list[int]:
    """Training tokens and types, also without the tuning part; unigrams alone count."""
    return [int(all_.sum()), int((all_ > 0).sum()), int(main.sum()), int((main > 0).sum())] if n == 1 else [0, 0, 0, 0]


def _replies(tables: pa.Table, places, all_: np.ndarray, main: np.ndarray, totals: list[list[int]]) -> pa.Table:
    """For each block the counts of the n-grams it asked for (all training documents, and
    without the tuning part for blocks of that part); rows without a block carry totals."""
    kinds, shard, order = tables.column("kind").to_pylist(), tables.column("shard")[0].as_py(), tables.column("n")[0].as_py()
    n, more = len(kinds), len(totals)
    return pa.table({
        "block": pa.array([*tables.column("block").to_pylist(), *[None] * more], pa.string()),
        "kind": pa.array([*kinds, *[None] * more], pa.int32()),
        "shard": pa.array([shard] * (n + more), pa.int32()),
        "n": pa.array([order] * (n + more), pa.int32()),
        "counts": pa.array([*(_pack(all_[p]) for p in places), *[None] * more], pa.binary()),
        "main": pa.array([*(_pack(main[p]) if k == 2 else None for k, p in zip(kinds, places)), *[None] * more], pa.binary()),
        "totals": pa.array([*[None] * n, *totals], pa.list_(pa.int64())),
    })


def _answer(key: tuple[pa.Scalar, ...], tables: pa.Table) -> pa.Table:
    """One shard of a one-level exchange."""
    every, all_, main, places = _merged(tables)
    return _replies(tables, places, all_, main, [_totals(all_, main, key[1].as_py())])


def _range_cuts(shard: int, shards: int, parts: int) -> np.ndarray:
    """Lower ends of equal parts of a shard's range of hashes, but for the first."""
    low = np.concatenate([[0.0], (np.arange(1, shards) * (2.0**64 / shards))])[shard]
    return (low + np.arange(1, parts) * (2.0**64 / shards / parts)).astype(np.uint64)


def _two_levels(asked: DataFrame, shards: int, parts: int) -> DataFrame:
    """The exchange over groups of blocks (column group): groups merge their requests for
    a shard and ask its parts, and pass the replies on to their blocks."""

    def ask(key: tuple[pa.Scalar, ...], tables: pa.Table) -> pa.Table:
        group, shard, n = (k.as_py() for k in key)
        every, all_, main, _ = _merged(tables)
        ends = np.concatenate([[0], np.searchsorted(every, _range_cuts(shard, shards, parts)), [len(every)]])
        rows = [(group, shard, p, n, pack_hashes(every[a:e]), _pack(all_[a:e]), _pack(main[a:e])) for p, (a, e) in enumerate(zip(ends[:-1], ends[1:])) if e > a]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["group", "shard", "part", "n", "hashes", "all", "main"])

    def add_up(key: tuple[pa.Scalar, ...], tables: pa.Table) -> pa.Table:
        lists = [unpack_hashes(x) for x in tables.column("hashes").to_pylist()]
        every = np.unique(np.concatenate(lists))
        places = [np.searchsorted(every, h) for h in lists]
        sums = []
        for column in ("all", "main"):
            total = np.zeros(len(every), np.uint64)
            for at, c in zip(places, tables.column(column).to_pylist()):
                total[at] += _unpack(c)
            sums.append(total)
        totals = [_totals(*sums, key[2].as_py()), *[[0, 0, 0, 0]] * (len(places) - 1)]
        return pa.table({
            **{c: tables.column(c) for c in ("group", "shard", "part", "n")},
            "all": pa.array([_pack(sums[0][p]) for p in places], pa.binary()), "main": pa.array([_pack(sums[1][p]) for p in places], pa.binary()),
            "totals": pa.array(totals, pa.list_(pa.int64())),
        })

    def pass_on(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        places = _merged(left)[3]
        right = right.sort_by("part")
        all_, main = (np.concatenate([_unpack(x) for x in right.column(c).to_pylist()]) for c in ("all", "main"))
        return _replies(left, places, all_, main, right.column("totals").to_pylist())

    by_group = asked.groupBy("group", "shard", "n")
    sums = by_group.applyInArrow(ask, "group int, shard int, part int, n int, hashes binary, all binary, main binary").groupBy("shard", "part", "n")
    sums = sums.applyInArrow(add_up, "group int, shard int, part int, n int, all binary, main binary, totals array<long>")
    return by_group.cogroup(sums.groupBy("group", "shard", "n")).applyInArrow(pass_on, ANSWERS)


def exchange(packed: DataFrame, order: int, shard_entries: int, fan_in: int) -> DataFrame:
    """Each block's n-gram counts in the corpus, by shard and order."""
    n_blocks, tokens = packed.agg(F.count("*"), F.sum("size")).first()
    entries = 0.6 * (tokens or 0) * order  # about so many are distinct in their blocks
    groups = max(1, math.ceil(n_blocks / fan_in))
    shards = max(1, math.ceil(entries / groups / shard_entries))
    asked = requests(packed, order, shards)
    if groups == 1:
        return cut_lineage(asked.groupBy("shard", "n").applyInArrow(_answer, ANSWERS))
    asked = cut_lineage(asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")))
    return cut_lineage(_two_levels(asked, shards, groups))


def counted(hashes: list[np.ndarray], starts, answers, column: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order: the count of the n-gram at each token, and that of its context."""
    by: dict[int, list] = {}
    for s, n, blob in sorted((s, n, x) for s, n, x in zip(*(answers.column(c).to_pylist() for c in ("shard", "n", column)))):
        by.setdefault(n, []).append(_unpack(blob))
    grams = []
    ends = None
    for n, h in enumerate(hashes, 1):
        u, inverse = np.unique(h, return_inverse=True)
        c = np.concatenate(by[n]).astype(np.float64)
        if n == 1:
            ends = c[np.searchsorted(u, mix64(np.array([END])))][0]
        grams.append(c[inverse])
    contexts: list[np.ndarray] = []
    for k in range(1, len(hashes)):
        before = np.empty(len(hashes[0]))
        before[1:] = grams[k - 1][:-1]
        before[starts[:-1]] = ends  # the padding alone: once a text
        contexts.append(before)
    return grams, contexts


def own_counts(grams: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As ``counted``, from the token's own document alone; ``grams`` are hashes."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    own = []
    for h in grams:
        _, at, n = np.unique(h ^ mix64(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
        own.append(n[at].astype(np.float64))
    contexts = []
    for g in own[:-1]:
        before = np.empty(len(g))
        before[1:] = g[:-1]
        before[starts[:-1]] = 1.0
        contexts.append(before)
    return own, contexts


def _bucket(contexts: list[np.ndarray], n: int) -> np.ndarray:
    """0 if no context was seen; else by the longest seen one and the logarithm of its count."""
    out = np.zeros(n, np.int64)
    for k, c in enumerate(contexts):
        steps = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1)
        out = np.where(c > 0, 1 + k * BUCKETS + steps, out)
    return out


def estimates(grams, contexts, total, types: float) -> np.ndarray:
    """Rows: maximum-likelihood estimates from the highest order down, then the uniform
    one. ``total`` is one number, or one for each token."""
    contexts = [np.broadcast_to(np.asarray(total, np.float64), grams[0].shape), *contexts]
    rows = [np.divide(g, c, out=np.zeros_like(g), where=c > 0) for g, c in zip(grams[::-1], contexts[::-1])]
    rows.append(np.full_like(grams[0], 1.0 / (types + 1)))
    return np.stack(rows)


def histogram(bucket: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of bucket and levels of the estimates (without the uniform one): number of
    the cell, tokens in it, and for each order the sum of the estimates."""
    with np.errstate(divide="ignore"):
        levels = np.where(p > 0, np.clip(LEVELS - 1 + np.floor(np.log2(p)), 1, LEVELS - 1), 0).astype(np.int64)
    cell = bucket
    for row in levels:
        cell = cell * LEVELS + row
    cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    return cells, n, np.stack([np.bincount(at, row, len(cells)) for row in p])


def learn_weights(cells: pd.DataFrame, order: int, types: float) -> np.ndarray:
    """Weights by bucket, by expectation-maximisation over the cells (cell, n, and the
    sums of the estimates s0, s1, ...)."""
    weights = np.full((1 + BUCKETS * (order - 1), order + 1), 1.0 / (order + 1))
    n = cells["n"].to_numpy(np.float64)
    p = np.column_stack([*(cells[f"s{k}"].to_numpy(np.float64) / n for k in range(order)), np.full(len(n), 1.0 / (types + 1))])
    buckets = cells["cell"].to_numpy(np.int64) // LEVELS**order
    for bucket in np.unique(buckets):
        mine = buckets == bucket
        w = weights[bucket]
        for _ in range(ROUNDS):
            part = p[mine] * w
            w = (n[mine, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n[mine].sum()
        # a share for the uniform part keeps unseen words possible
        weights[bucket] = (w + 1e-6) / (w + 1e-6).sum()
    return weights


def model(packed: DataFrame, answers: DataFrame, order: int) -> tuple[np.ndarray, int, int]:
    """Weights by bucket, training tokens, training types."""
    t = answers.where("totals is not null").select(*(F.sum(F.col("totals")[i]) for i in range(4))).first()
    total, types, total_main, types_main = (int(x or 0) for x in t)
    sums = [f"s{k}" for k in range(order)]

    def tune(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, starts = unpack_tokens(left.column("tokens")[0].as_py())
        grams, contexts = counted(gram_hashes(tokens, starts, order), starts, right, "main")
        cells, n, p = histogram(_bucket(contexts, len(tokens)), estimates(grams, contexts, total_main, types_main)[:-1])
        return pa.table({"cell": pa.array(cells), "n": pa.array(n), **{c: pa.array(row) for c, row in zip(sums, p)}})

    own = answers.where("block is not null and kind = 2")
    tuned = packed.where("kind = 2").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(tune, "cell long, n long, " + ", ".join(f"{c} double" for c in sums))
    # sums of doubles in a fixed order and precision, so that reruns agree
    exact = [F.sum(F.round(F.col(c), 9).cast("decimal(38,9)")).cast("double").alias(c) for c in sums]
    cells = tuned.groupBy("cell").agg(F.sum("n").alias("n"), *exact).orderBy("cell").toPandas()
    return learn_weights(cells, order, types_main), total, types


def score_documents(docs: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    packed = cut_lineage(blocks(docs))
    answers = exchange(packed, order, shard_entries, fan_in)
    weights, total, types = model(packed, answers, order)

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids")[0].as_py()
        kind = left.column("kind")[0].as_py()
        tokens, starts = unpack_tokens(left.column("tokens")[0].as_py())
        hashes = gram_hashes(tokens, starts, order)
        grams, contexts = counted(hashes, starts, right, "counts")
        known = grams[0]
        seen_total = total
        if kind:
            own, own_contexts = own_counts(hashes, starts)
            grams, contexts = ([a - b for a, b in zip(x, y)] for x, y in ((grams, own), (contexts, own_contexts)))
            seen_total = total - np.repeat(np.diff(starts), np.diff(starts)).astype(np.float64)
        p = estimates(grams, contexts, seen_total, types)
        logs = np.log10((weights[_bucket(contexts, len(tokens))].T * p).sum(axis=0))
        base = np.log10((known + ALPHA) / (total + ALPHA * (types + 1)))
        at = starts[:-1]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([kind == 0] * len(ids)), "n_tokens": pa.array(np.diff(starts)),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(ids), total)),
            "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(logs, at)),
        })

    own = answers.where("block is not null")
    return packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
