"""Exact-substring dedup by suffix arrays.

A byte is removed if a 200-byte string that covers it also starts anywhere else.

Which strings must be compared: every 200-byte window holds one lowest-hashed
32-byte gram, its anchor, and equal windows have the same anchor at the same place.
The windows of one anchor occurrence overlap into one piece of at most 368 bytes.
Spark groups pieces by anchor; anchors that occur once are done. Equal pieces
are folded into one with its number of copies, and the text of one of them is
fetched. So each shard of anchors holds all windows that could equal each other.

Per shard: a suffix array over its pieces by Larsson-Sadakane refinement (ranks by
8 bytes, then doubled, only groups that are still tied are sorted again, to a
depth of 200), then Kasai's common prefixes, run over all pieces side by side. A
window is repeated if it shares 200 bytes with a neighbour in suffix order or if
its piece has copies.

The pieces of an anchor with more than ``MAX_PIECES`` different ones are cut again by
a second anchor, the lowest gram by another hash, and so on up to ``DEPTH`` times:
texts that differ around a frequent gram part there, and equal cuts are folded. What
is still larger is dealt over sub-shards. Each of those has its own suffix array, and
they are merged pairwise: the windows of one are looked up in the suffix array of the
other by binary search.

Defined cases: null text counts as empty, texts under 200 bytes have no window; a very
long text is scanned stretch by stretch and whole; nothing matches across documents;
repeated rows are each other's copies, and their pieces are fetched once; ids may
repeat or be null: rows are told apart by the id and a 64-bit hash of the text, without an id
by two such hashes; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, table

LENGTH = 200
GRAM = 32
#: Different pieces of one anchor in one suffix array.
MAX_PIECES = 4_000
#: Further anchors by which the pieces of a frequent one are cut.
DEPTH = 3
#: Anchors of that kind up to which they are sent to every task.
SENT_ANCHORS = 100_000
#: Parts over which a map task deals the pieces of an anchor that it has seen before.
SALTS = 64
#: Occurrences of a piece that one row holds.
ROW_OCCURRENCES = 1024
#: Bytes of pieces in one suffix array.
SHARD_BYTES = 1_200_000
#: Occurrences folded at a time in a map task.
FOLD_ROWS = 400_000
#: Bytes of one text that are scanned at a time.
SCAN_BYTES = 4_000_000


# ---- anchors ------------------------------------------------------------------


def _words(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian."""
    return np.lib.stride_tricks.as_strided(a, (len(a) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def anchors(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of windows, anchor hash) of the pieces of a text:
    maximal runs of windows with the same leftmost lowest gram by the seed's hash."""
    a = np.frombuffer(data, np.uint8)
    n_windows = len(a) - LENGTH + 1
    if n_windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    if n_windows > SCAN_BYTES:
        parts = []
        for at in range(0, n_windows, SCAN_BYTES):
            s, n, h = anchors(data[at : min(at + SCAN_BYTES, n_windows) + LENGTH - 1], seed)
            parts.append((s + at, n, h))
        return tuple(np.concatenate(c) for c in zip(*parts))  # type: ignore[return-value]
    v = _words(a)
    n_grams = len(a) - GRAM + 1
    h = np.full(n_grams, (seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(0, GRAM, 8):
        h ^= v[j : j + n_grams]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    low, span, want = h, 1, LENGTH - GRAM + 1
    while span < want:
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    # a piece ends where the lowest hash changes, and where its leftmost gram leaves the
    # window while another of the same hash stays, as in periodic text
    leaves = h[: n_windows - 1] == low[:-1]
    starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | leaves])
    sizes = np.diff(np.r_[starts, n_windows])
    return starts, sizes, low[starts]


def piece_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each piece's bytes, from one polynomial prefix sum."""
    a = np.frombuffer(data, np.uint8)
    base = int(starts[0])
    a = a[base : int(starts[-1] + sizes[-1]) + LENGTH - 1]
    step, back = np.uint64(0x2545F4914F6CDD1D), np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
    out = np.empty(len(starts), np.uint64)
    block = 1 << 20
    # positions restart in every block of pieces, so that the powers stay few
    k = 0
    while k < len(starts):
        lo = int(starts[k]) - base
        e = int(np.searchsorted(starts, starts[k] + block))
        hi = int(starts[e - 1] + sizes[e - 1]) - base + LENGTH - 1
        powers = np.full(hi - lo, step, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a[lo:hi].astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        s = starts[k:e] - base - lo
        n = sizes[k:e] + LENGTH - 1
        inverse = np.full(hi - lo, back, np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        out[k:e] = mix64((sums[s + n] - sums[s]) * inverse[s] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k = e
    return out


OCCURRENCES = "anchor long, piece long, size int, rows binary, salt int, weight int"
#: One occurrence: the document's two keys and the place, as 20 bytes.
ROW = np.dtype([("d", ">i8"), ("t", ">i8"), ("at", ">i4")])


def occurrences(docs: DataFrame) -> DataFrame:
    """anchor, piece, size (windows), rows: the pieces of all texts, folded within each map
    task. The first piece of an anchor in a task has salt 0 and as weight the number of
    its occurrences there; the others, which are known to occur with it, are dealt by
    their salt, so that a frequent anchor does not come together in one task."""

    def run(it):
        held: list[tuple] = []
        count = 0

        def fold():
            anchor, piece, size, d, t, at = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((at, d, piece, anchor))
            anchor, piece, size, d, t, at = (x[order] for x in (anchor, piece, size, d, t, at))
            change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
            within = np.arange(len(d)) - np.repeat(change, np.diff(np.r_[change, len(d)]))
            first = np.flatnonzero(within % ROW_OCCURRENCES == 0)  # a frequent piece takes several rows
            packed = np.empty(len(d), ROW)
            packed["d"], packed["t"], packed["at"] = d, t, at
            raw = packed.tobytes()
            ends = np.r_[first, len(anchor)] * ROW.itemsize
            heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            part = (within[first] // ROW_OCCURRENCES).astype(np.uint64)
            salt = 1 + (mix64(piece[first].view(np.uint64) + part) % np.uint64(SALTS - 1)).astype(np.int32)
            weight = np.full(len(first), 2, np.int32)
            at_head = np.searchsorted(first, heads)  # every anchor begins with a piece
            salt[at_head], weight[at_head] = 0, np.diff(np.r_[heads, len(anchor)])
            for lo in range(0, len(first), 10_000):
                f = first[lo : lo + 10_000]
                rows = pa.array([raw[x:y] for x, y in zip(ends[lo : lo + len(f)].tolist(), ends[lo + 1 : lo + len(f) + 1].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[f]), pa.array(piece[f]), pa.array(size[f].astype(np.int32)), rows, pa.array(salt[lo : lo + len(f)].astype(np.int32)), pa.array(weight[lo : lo + len(f)])],
                    names=["anchor", "piece", "size", "rows", "salt", "weight"],
                )

        for b in it:
            for d, t, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode("utf-8", "surrogatepass")
                starts, sizes, low = anchors(data)
                if not len(starts):
                    continue
                n = len(starts)
                held.append((low.view(np.int64), piece_hashes(data, starts, sizes).view(np.int64), sizes, np.full(n, d), np.full(n, t), starts))
                count += n
                if count >= FOLD_ROWS:
                    yield from fold()
                    held, count = [], 0
        if held:
            yield from fold()

    return docs.select("d", "t", "text").mapInArrow(run, OCCURRENCES)


# ---- suffix arrays ------------------------------------------------------------


def suffix_ranks(text: np.ndarray, pieces: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Positions of all windows in the order of their 200 bytes. ``text`` is the pieces
    one after the other; ``pieces`` their starts; ``windows`` their numbers of windows.
    Ranks are refined from 8 bytes by doubling; at each depth only positions that are
    needed later and still tied with another are sorted again."""
    offset = np.arange(len(text)) - np.repeat(pieces, windows + LENGTH - 1)
    room = np.repeat(windows, windows + LENGTH - 1) - offset  # windows right of a position in its piece

    def at_depth(depth: int) -> np.ndarray:
        return np.flatnonzero(room > depth - LENGTH)

    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = _words(padded)[: len(text)].byteswap()
    where = at_depth(8)
    order = where[np.argsort(key[where], kind="stable")]
    sorted_key = key[order]
    rank = np.zeros(len(text), np.int64)
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        keep = room[order] > depth + step - LENGTH
        order = order[keep]
        # ranks are places in the full order; ties are runs of equal rank
        r = rank[order]
        tied = np.zeros(len(order), bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if len(at):
            p = order[at]
            r1, r2 = rank[p], rank[p + step]
            s = np.argsort(r1 * len(text) + r2, kind="stable")
            p, r1, r2 = p[s], r1[s], r2[s]
            order[at] = p
            head = np.r_[True, r1[1:] != r1[:-1]]
            new = head | np.r_[True, r2[1:] != r2[:-1]]
            # a group's members keep its rank plus their place in it, so ranks stay ordered
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            block = np.flatnonzero(new)[np.cumsum(new) - 1]
            fresh = r1 + (block - first)
            rank[p] = fresh
        depth += step
    return order


def kasai(text: np.ndarray, pieces: np.ndarray, windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix, up to 200, of each window with the one before it in suffix order.
    Kasai's bound (a position's prefix is at most one shorter than that of the
    position to its left) is carried along all pieces at once, where the order of
    windows, cut at 200 bytes and at piece ends, lets it hold."""
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(len(text) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    words = _words(np.concatenate([text, np.zeros(8, np.uint8)]))
    lcp = np.zeros(len(text), np.int16)
    by_size = np.argsort(-windows, kind="stable")
    pieces, windows = pieces[by_size], windows[by_size]
    carried = np.zeros(len(pieces), np.int64)
    for k in range(int(windows[0]) if len(windows) else 0):
        live = int(np.searchsorted(-windows, -k, side="left"))
        p = pieces[:live] + k
        q = before[p]
        h = np.maximum(carried[:live] - 1, 0)
        h[q < 0] = 0
        todo = np.flatnonzero(q >= 0)
        while len(todo):
            x = words[np.minimum(p[todo] + h[todo], len(words) - 1)] ^ words[np.minimum(q[todo] + h[todo], len(words) - 1)]
            low = x & (~x + np.uint64(1))
            zeros = np.where(x == 0, 64, np.bitwise_count(low - np.uint64(1)).astype(np.int64)) >> 3
            h[todo] = np.minimum(h[todo] + zeros, LENGTH)
            todo = todo[(x == 0) & (h[todo] < LENGTH)]
        lcp[p] = h
        # the bound holds if both right neighbours are windows and still in this order
        a, b = place[p + 1], place[q + 1]
        carried[:live] = np.where((q >= 0) & (b >= 0) & (b < a), h, 0)
    return lcp


def _layout(texts: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(windows + LENGTH - 1)])[:-1]


def repeated_in_shard(texts: list[bytes], windows: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte position: does a window that starts there occur again in the shard
    (or has its piece copies)? And the suffix order."""
    text, pieces = _layout(texts, windows)
    order = suffix_ranks(text, pieces, windows)
    lcp = kasai(text, pieces, windows, order)
    flags = np.repeat(copies > 1, windows + LENGTH - 1)
    with_previous = np.flatnonzero(lcp >= LENGTH)
    flags[with_previous] = True
    hit = np.flatnonzero(lcp[order] >= LENGTH)
    flags[order[hit - 1]] = True
    offset = np.arange(len(text)) - np.repeat(pieces, windows + LENGTH - 1)
    flags &= offset < np.repeat(windows, windows + LENGTH - 1)
    return flags, order


def found_in(text: np.ndarray, order: np.ndarray, other: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows of ``other`` (at ``starts``) are in the suffix array of ``text``:
    binary search for all of them at once, 8 bytes compared at a time."""
    wt, wo = (_words(np.concatenate([x, np.zeros(8, np.uint8)])) for x in (text, other))

    def compare(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        sign = np.zeros(len(p), np.int8)
        todo = np.arange(len(p))
        for j in range(0, LENGTH, 8):
            x, y = wt[p[todo] + j].byteswap(), wo[q[todo] + j].byteswap()
            sign[todo] = np.where(x < y, -1, (x > y).astype(np.int8))
            todo = todo[x == y]
            if not len(todo):
                break
        return sign

    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order))
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            break
        mid = (lo[live] + hi[live]) // 2
        less = compare(order[mid], starts[live]) < 0
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    inside = np.flatnonzero(lo < len(order))
    out = np.zeros(len(starts), bool)
    out[inside] = compare(order[lo[inside]], starts[inside]) == 0
    return out


def _runs(flags: np.ndarray, pieces: np.ndarray, windows: np.ndarray) -> list[list[dict]]:
    """Per piece the runs of flagged window starts, from the piece's start, end exclusive."""
    out = []
    for p, n in zip(pieces.tolist(), windows.tolist()):
        f = flags[p : p + n]
        if not f.any():
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, f, False].astype(np.int8)))
        out.append([{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])])
    return out


FOUND = "anchor long, piece long, runs array<struct<a:int,b:int>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _shard(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A shard, or a pair of sub-shards (sides 0 and 1) of one hot anchor. A piece that
    came several times counts once."""
    named = list(zip(group.column("anchor").to_pylist(), group.column("piece").to_pylist()))
    first = {k: i for i, k in reversed(list(enumerate(named)))}
    if len(first) < len(named):
        group = group.take(pa.array(sorted(first.values())))
    side = group.column("side").to_numpy()
    windows = group.column("size").to_numpy().astype(np.int64)
    copies = group.column("copies").to_numpy()
    texts = group.column("bytes").to_pylist()
    anchor, piece = group.column("anchor").to_pylist(), group.column("piece").to_pylist()
    at = [np.flatnonzero(side == s) for s in (0, 1)]
    found: list[tuple[int, int, list]] = []
    if not len(at[1]) or not len(at[0]):
        one = at[0] if len(at[0]) else at[1]
        flags, _ = repeated_in_shard([texts[i] for i in one], windows[one], copies[one])
        runs = _runs(flags, _layout([texts[i] for i in one], windows[one])[1], windows[one])
        found = [(anchor[i], piece[i], r) for i, r in zip(one.tolist(), runs) if r]
    else:
        sides = [([texts[i] for i in x], windows[x]) for x in at]
        laid = [_layout(*s) for s in sides]
        orders = [suffix_ranks(t, p, w) for (t, p), (_, w) in zip(laid, sides)]
        for me, other in ((0, 1), (1, 0)):
            starts = np.sort(orders[me])
            flags = np.zeros(len(laid[me][0]), bool)
            flags[starts] = found_in(laid[other][0], orders[other], laid[me][0], starts)
            runs = _runs(flags, laid[me][1], sides[me][1])
            found += [(anchor[i], piece[i], r) for i, r in zip(at[me].tolist(), runs) if r]
    return pa.table({"anchor": pa.array([x[0] for x in found], pa.int64()), "piece": pa.array([x[1] for x in found], pa.int64()), "runs": pa.array([x[2] for x in found], _RUNS)})


# ---- the job ------------------------------------------------------------------


class Seen:
    """Which rows (d and t) a task has had, to pass repeated rows once."""

    #: Keys that are remembered; later ones may come twice, which no result depends on.
    LIMIT = 2_000_000

    def __init__(self):
        self.keys: set[tuple[int, int]] = set()

    def fresh(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, k in enumerate(zip(batch.column("d").to_pylist(), batch.column("t").to_pylist())):
            if k not in self.keys:
                keep.append(i)
                if len(self.keys) < self.LIMIT:
                    self.keys.add(k)
        return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def packed(docs: DataFrame, once: bool = False) -> DataFrame:
    """doc_id, d, t, z: the texts compressed, as they are shuffled; with ``once``, of equal
    rows in a task the first."""

    def run(it):
        z, seen = zstandard.ZstdCompressor(level=3), Seen()
        for b in it:
            if once:
                b = seen.fresh(b)
            texts = [z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.binary())], names=["doc_id", "d", "t", "z"])

    return docs.select("doc_id", "d", "t", "text").mapInArrow(run, "doc_id long, d long, t long, z binary")


def _spread(runs: DataFrame) -> DataFrame:
    """d, t, a, b: the repeated spans of every occurrence."""

    def run(it):
        for b in it:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for rows, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(rows, ROW)
                for x in found:
                    at = r["at"].astype(np.int64)
                    for c, v in zip(out, (r["d"].astype(np.int64), r["t"].astype(np.int64), at + x["a"], at + x["b"] + LENGTH - 1)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["d", "t", "a", "b"])

    return runs.select("rows", "runs").mapInArrow(run, "d long, t long, a long, b long")


def _fetch(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of one occurrence of each piece, cut out of its document. Of equal rows one
    is cut, but for copies that different tasks have: a piece may still come several times."""
    wanted = reps.groupBy("d", "t").agg(F.collect_list(F.struct("at", "size", "anchor", "piece", "copies")).alias("cuts"))

    def run(it):
        seen = Seen()
        for b in it:
            rows = []
            b = seen.fresh(b)
            for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = zstandard.ZstdDecompressor().decompress(text)
                rows += [(c["anchor"], c["piece"], c["size"], c["copies"], data[c["at"] : c["at"] + c["size"] + LENGTH - 1]) for c in cuts]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["anchor", "piece", "size", "copies", "bytes"])

    return packed(docs, once=True).join(wanted, ["d", "t"]).select("z", "cuts", "d", "t").mapInArrow(run, PIECES)


PIECES = "anchor long, piece long, size int, copies long, bytes binary"
CUT = f"{PIECES}, of_anchor long, of_piece long, shift int"


def _cut_again(seed: int):
    """Pieces cut by the anchors of another hash: the rows of ``CUT``."""

    def run(it):
        for b in it:
            rows = []
            for anchor, piece, _, copies, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                starts, sizes, low = anchors(data, seed)
                named = mix64(low ^ np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist()
                hashes = piece_hashes(data, starts, sizes).view(np.int64).tolist()
                rows += [(a, h, n, copies, data[at : at + n + LENGTH - 1], anchor, piece, at) for a, h, n, at in zip(named, hashes, sizes.tolist(), starts.tolist())]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            names = ["anchor", "piece", "size", "copies", "bytes", "of_anchor", "of_piece", "shift"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

    return run


def _frequent(pieces: DataFrame, max_pieces: int) -> DataFrame:
    """anchor, kinds: the anchors of more than ``max_pieces`` different pieces."""
    return cut_lineage(pieces.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > max_pieces))


def _repeated(pieces: DataFrame, frequent: DataFrame, max_pieces: int, shard_bytes: int, shards: int, depth: int) -> DataFrame:
    """The rows of ``FOUND`` of different pieces (``PIECES``)."""
    n = frequent.count()
    if not n:
        return _by_shards(pieces.withColumn("parts", F.lit(1)), shards)
    pieces = cut_lineage(pieces)
    sent = F.broadcast(frequent) if n <= SENT_ANCHORS else frequent
    rare = pieces.join(sent, "anchor", "left_anti").withColumn("parts", F.lit(1))
    many = pieces.join(sent, "anchor").dropDuplicates(["anchor", "piece"])
    if depth == DEPTH:
        return _by_shards(rare.unionByName(many.withColumn("parts", F.ceil(F.col("kinds") / F.lit(max_pieces)).cast("int")).drop("kinds")), shards)
    cut = cut_lineage(many.select("anchor", "piece", "size", "copies", "bytes").mapInArrow(_cut_again(depth + 1), CUT))
    folded = cut.groupBy("anchor", "piece").agg(F.first("size").alias("size"), F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"))
    size = cut.agg(F.sum(F.length("bytes"))).first()[0] or 0
    deeper = _repeated(folded, _frequent(folded, max_pieces), max_pieces, shard_bytes, max(1, math.ceil(size / shard_bytes)), depth + 1)
    shifted = F.expr("transform(runs, r -> named_struct('a', r.a + shift, 'b', r.b + shift))").alias("runs")
    back = cut.select("anchor", "piece", "of_anchor", "of_piece", "shift").join(deeper, ["anchor", "piece"])
    return _by_shards(rare, shards).unionByName(back.select(F.col("of_anchor").alias("anchor"), F.col("of_piece").alias("piece"), shifted))


def _by_shards(pieces: DataFrame, shards: int) -> DataFrame:
    """Suffix arrays over pieces dealt by anchor; those of an anchor with several parts
    in sub-shards, met in pairs."""
    mine = F.pmod(F.xxhash64("piece"), F.col("parts")).cast("int")
    pairs = F.expr("""
        case when parts <= 1 then array(named_struct('lo', -1, 'hi', -1, 'side', 0))
             else transform(sequence(0, parts - 1), o -> named_struct('lo', least(mine, o), 'hi', greatest(mine, o), 'side', if(mine > o, 1, 0))) end""")
    dealt = pieces.withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    dealt = dealt.withColumn("shard", F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor")))
    return dealt.select("shard", "pair.*", "anchor", "piece", "size", "copies", "bytes").groupBy("shard", "lo", "hi").applyInArrow(_shard, FOUND)


def repeated_runs(docs: DataFrame, max_pieces: int = MAX_PIECES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """d, t, spans: for every document with repeated bytes, the spans [a, b) they fill.
    ``docs`` has doc_id, d and t (the row's keys, see ``keyed``) and text."""
    spread = occurrences(docs).repartition("anchor", "salt")
    together = Window.partitionBy("anchor", "salt")
    number = F.expr(f"cast(length(rows) div {ROW.itemsize} as bigint)")
    several = cut_lineage(spread.withColumn("total", F.sum("weight").over(together)).where("total > 1").select("anchor", "piece", "size", "rows"))
    reps = several.groupBy("anchor", "piece").agg(F.min(F.substring("rows", 1, ROW.itemsize)).alias("r"), F.first("size").alias("size"), F.sum(number).alias("copies"))
    part = lambda at, n, kind: F.expr(f"cast(conv(hex(substring(r, {at}, {n})), 16, -10) as {kind})")
    located = reps.select("anchor", "piece", "size", "copies", part(1, 8, "bigint").alias("d"), part(9, 8, "bigint").alias("t"), part(17, 4, "int").alias("at"))
    size = several.agg(F.sum(F.lit(LENGTH) + F.col("size"))).first()[0] or 0
    found = _repeated(_fetch(located, docs), _frequent(reps, max_pieces), max_pieces, shard_bytes, max(1, math.ceil(size / shard_bytes)), 0)
    spans = _spread(several.join(found, ["anchor", "piece"]))
    # a set, as rows of equal id and text say the same
    return spans.groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), d, t: the id, or without one a hash of the text, and
    another hash of the text. Rows of equal keys have the same id and text, and so the same result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text", F.lit("second"))).alias("d"), F.xxhash64("text").alias("t"))


def dedup(docs: DataFrame, keep_text: bool = False, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with
    ``keep_text`` the spans and the remaining bytes."""
    rows = keyed(docs)
    marked = packed(rows).join(repeated_runs(rows, **limits), ["d", "t"], "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if keep_text else [])]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]

    def run(it):
        for b in it:
            rows = []
            for doc_id, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = zstandard.ZstdDecompressor().decompress(text)
                cut = merged([(s["a"], s["b"]) for s in spans or ()])
                parts, at = [], 0
                for a, e in cut:
                    parts.append(data[at:a])
                    at = e
                kept = b"".join([*parts, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [list(c) for c in cut], kept)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept binary" if keep_text else "")
    return marked.select("doc_id", "z", "spans").mapInArrow(run, schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
