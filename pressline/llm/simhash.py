"""SimHash near-duplicates over deletion-variant signatures.

Two 64-bit fingerprints within two bits of each other agree, in one of their two
32-bit segments, in all bits but one at most. So each distinct fingerprint is
indexed under its 64 one-wildcard segment variants (a segment with one bit
deleted), an equality on the variant finds every pair, and the pair is verified
on the full fingerprints. A variant that very many fingerprints share is not
paired up: its members are cut again by variants of the bits that are still free,
until the number of possible fingerprints behind a key is bounded by its bits.

Exact copies never meet each other: everything works on distinct fingerprints.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; a text of one or two words is one shingle; repeated rows keep their row;
a null doc_id never names a component unless it has no other member; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import ascii_lower, cut_lineage, find_words, release_files, table

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints of one key that are compared with each other at once; keys with more are cut again.
PAIRED = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text, repeats included."""
    words = [w.encode("utf-8", "surrogatepass") for w in find_words(ascii_lower(text or ""))]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """key, fp (the fingerprint as a signed long) for every row; a narrow pass over the whole texts."""

    def run(it):
        for b in it:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, fp long")


#: Keys of the three rounds, as SQL over ``fp`` and, after the first, the ``key``
#: before it. A key's lowest bits tell which segment, and then which half of the
#: other one, it has fixed.
ROUNDS = (
    """transform(sequence(0, 63), i -> (xxhash64(i, shiftrightunsigned(fp, cast(32 * (i div 32) as int)) & 4294967295L & ~shiftleft(1L, i % 32)) & -2L) | (i div 32))""",
    """transform(sequence(0, 31), i -> (xxhash64(key, i, shiftrightunsigned(fp, cast(32 * (1 - (key & 1)) + 16 * (i div 16) as int)) & 65535L & ~shiftleft(1L, i % 16)) & -4L)
       | (2 * (1 - (key & 1)) + (i div 16)))""",
    """transform(sequence(0, 15), i -> xxhash64(key, i, shiftrightunsigned(fp, cast(32 * (shiftright(key, 1) & 1) + 16 * (1 - (key & 1)) + 8 * (i div 8) as int)) & 255L & ~shiftleft(1L, i % 8)))""",
)


def _link_runs(limit: int):
    """Over rows sorted by key: verified links within each run of equal keys, as a
    spanning set (a, b); the members of runs beyond ``limit`` go out as hot rows.
    At most ``limit`` members of an unfinished run are held."""

    def links(k, f):
        n = len(k)
        label = np.arange(n)
        pairs = []
        d = 1
        while d < n:
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            near = same[np.bitwise_count(f[same] ^ f[same + d]) <= MAX_BITS]
            pairs.append(np.stack([near, near + d]))
            d += 1
        if not pairs:
            return np.zeros((0, 2), np.int64)
        a, b = np.concatenate(pairs, axis=1)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(n))
        out = np.stack([f[moved], f[label[moved]]], axis=1).view(np.int64)
        return np.unique(out, axis=0)

    def run(it):
        def rows(kind, key, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])

        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None
        for batch in it:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(k, hot, side="right")) if len(k) else 0
                if n:
                    yield rows(1, k[:n], f[:n].view(np.int64), f[:n].view(np.int64))
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if not len(k):
                continue
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            big = sizes > limit
            last = starts[-1]
            held_k, held_f = k[last:].copy(), f[last:].copy()
            if big[-1]:
                hot, held_k, held_f = int(k[-1]), held_k[:0], held_f[:0]
            is_big = np.repeat(big, sizes)
            if is_big.any():
                at = np.flatnonzero(is_big)
                yield rows(1, k[at], f[at].view(np.int64), f[at].view(np.int64))
            done = np.flatnonzero(~is_big & (np.arange(len(k)) < last))
            found = links(k[done], f[done])
            if len(found):
                yield rows(0, np.zeros(len(found), np.int64), found[:, 0], found[:, 1])
        found = links(held_k, held_f)
        if len(found):
            yield rows(0, np.zeros(len(found), np.int64), found[:, 0], found[:, 1])

    return run


def _matched(variants: DataFrame, limit: int) -> DataFrame:
    """One round: equality on the variant key, then verification."""
    dealt = variants.repartition("key").sortWithinPartitions("key", "fp")
    return cut_lineage(dealt.select("key", "fp").mapInArrow(_link_runs(limit), "kind int, key long, a long, b long"))


def links(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose closure is that
    of all pairs within two bits. Up to three rounds; the later ones only see keys
    that more than ``paired`` fingerprints share. After the third, 11 bits are
    free, so a key has at most 2,048 fingerprints."""
    found, left = [], distinct
    for n, key in enumerate(ROUNDS):
        matched = _matched(left.select("fp", F.explode(F.expr(key)).alias("key")), paired if n < 2 else 1 << 12)
        found.append(matched.where("kind = 0").select("a", "b"))
        left = matched.where("kind = 1").select("key", F.col("a").alias("fp"))
        if left.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


#: Parts in which the neighbours of one node are dealt, and links that one task should get.
SALTS, TASK_LINKS = 64, 200_000


def _beside_minimum(pairs: DataFrame, tasks: int) -> DataFrame:
    """u, v, m: each pair beside the smallest v of its u. A node with very many
    neighbours is dealt in ``SALTS`` parts: minima of the parts first, and the minimum
    goes back to those parts that have rows. ``tasks`` is also what the steps between the
    shuffles are kept to, as each of their tasks writes files of its own."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    dealt = salted.coalesce(tasks).repartition(tasks, "u", "salt")
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).coalesce(tasks).repartition(tasks, "u")
    low = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    back = low.select("u", "m", F.explode("salts").alias("salt")).coalesce(tasks).repartition(tasks, "u", "salt")
    return dealt.join(back, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components by alternating large-star and small-star
    steps; root is the smallest node. Each step is a grouped minimum and a join, in as
    many tasks as the links that are left ask for."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, tasks = now, -(-now[0] // TASK_LINKS)
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _beside_minimum(both, tasks).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        near = _beside_minimum(large, tasks)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.where("v = m").select("u", "v"))
        edges = cut_lineage(small.where("u <> v").coalesce(tasks).repartition(tasks, "u", "v").distinct().coalesce(tasks))
        del both, large, near, small
        release_files(edges.sparkSession)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    fps = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by shingle similarity, for filtering a corpus ------------------

#: Five-word shingles and the Jaccard similarity from which texts count as near copies.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Min-wise bands and rows: two texts at the similarity miss each other with 2 in 10,000.
BANDS, BAND_ROWS = 16, 4
#: Members of one band key that go out as candidate pairs; the pairs of larger keys are compared in blocks.
COMPARED = 32
#: Hubs of a stretch of a larger key, and its length.
HUBS, STRETCH = 4, 2048
#: Bytes of shingle sets, and texts, of a block of a large key (on average; blocks are dealt by hash).
BLOCK_BYTES, BLOCK_NODES = 4 << 20, 1024
#: Members outside the commonest class beyond which a group is cut by prefixes first.
WIDE = 4096


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles (of the whole sequence, if shorter)."""
    words = [w.encode("utf-8", "surrogatepass") for w in find_words(ascii_lower(text or ""))]
    joined = b" ".join(words)
    if len(words) <= COPY_SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[COPY_SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def _band_keys(hashes: np.ndarray) -> list[int]:
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lows = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 4096):
        lows = np.minimum(lows, ((hashes[at : at + 4096, None] * factors) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    bands = lows.reshape(BANDS, BAND_ROWS)
    return [int.from_bytes(xxhash.xxh64_digest(b.tobytes(), i), "big", signed=True) for i, b in enumerate(bands)]


ROW_KEYS = ("k1", "k2")


def _with_row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, document (the row) and two hashes of the whole row (but for maps)."""
    parts = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    keys = (F.xxhash64(F.lit(i), *parts).alias(k) for i, k in enumerate(ROW_KEYS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("document"), *keys)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row keys, node (hash of the shingle set), size (its shingles), fp, bands of every row."""

    def run(it):
        for b in it:
            node, size, fp, bands = [], [], [], []
            for text in b.column(3).to_pylist():
                h = shingle_hashes(text)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                size.append(len(h))
                fp.append(fingerprint(text, COPY_SHINGLE))
                bands.append(_band_keys(h))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", *ROW_KEYS, "node", "size", "fp", "bands"],
            )

    return _with_row_keys(docs).select("doc_id", *ROW_KEYS, "text").mapInArrow(run, "doc_id long, k1 long, k2 long, node long, size long, fp long, bands array<long>")


def _candidate_runs(limit: int):
    """Over rows (key, node) sorted by key: all pairs of runs up to ``limit`` (kind 0);
    members of longer runs go out as hot (kind 1)."""

    def run(it):
        held_k, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(k, n):
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            hot = np.repeat(sizes > limit, sizes)
            if hot.any():
                yield 1, k[hot], n[hot], n[hot]
            k, n = k[~hot], n[~hot]
            for d in range(1, limit):
                if len(k) <= d:
                    break
                same = np.flatnonzero((k[d:] == k[:-d]) & (n[d:] != n[:-d]))
                if not len(same):
                    break
                yield 0, k[same], np.minimum(n[same], n[same + d]), np.maximum(n[same], n[same + d])

        def rows(found):
            for kind, k, a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])

        for batch in it:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            n = np.concatenate([held_n, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            if last == 0 and len(k) > 8 * limit:  # one key throughout: pass its members on, keep enough to know it again
                yield from rows([(1, k[: -limit - 1], n[: -limit - 1], n[: -limit - 1])])
                held_k, held_n = k[-limit - 1 :].copy(), n[-limit - 1 :].copy()
                continue
            held_k, held_n = k[last:].copy(), n[last:].copy()
            yield from rows(work(k[:last], n[:last]))
        yield from rows(work(held_k, held_n))

    return run


def _hub_runs(hubs: int, chunk: int):
    """Over rows (key, node, rest) of large keys, sorted: each node with its successor
    and with the hubs of its stretch, the nodes that agree most with the stretch's
    commonest bands."""

    def pairs(k, n, rest):
        out = [np.stack([n[:-1], n[1:]])[:, k[1:] == k[:-1]]]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
            agree = np.zeros(b - a, np.int64)
            for column in rest[a:b].T:
                _, at, times = np.unique(column, return_inverse=True, return_counts=True)
                agree += at == times.argmax()
            for h in np.argsort(-agree, kind="stable")[:hubs]:
                out.append(np.stack([np.full(b - a, n[a + h]), n[a:b]]))
        p = np.concatenate(out, axis=1)
        p = np.unique(np.sort(p[:, p[0] != p[1]], axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    def run(it):
        k, n, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS - 1), np.int64)
        for batch in it:
            if not batch.num_rows:
                continue
            k = np.concatenate([k, batch.column(0).to_numpy(zero_copy_only=False)])
            n = np.concatenate([n, batch.column(1).to_numpy(zero_copy_only=False)])
            rest = np.concatenate([rest, batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS - 1)])
            while len(k) > 2 * chunk:
                yield pairs(k[:chunk], n[:chunk], rest[:chunk])
                k, n, rest = k[chunk - 1 :], n[chunk - 1 :], rest[chunk - 1 :]
        if len(k):
            yield pairs(k, n, rest)

    return run


def _copy_candidates(nodes: DataFrame, compared: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of nodes that share a band, and (key, node): the members of the
    keys of which these are not all pairs. All pairs of a key with up to ``compared``
    nodes. The nodes of a larger key are ordered by their other bands; each is paired
    with its successor and with a few hubs of its stretch. That joins most of a large
    group at a cost that grows with the group and not with its square; the pairs it
    leaves are for ``_links_between``."""
    level = nodes.select(F.explode("bands").alias("key"), "node")
    dealt = level.repartition("key").sortWithinPartitions("key", "node").select("key", "node")
    found = cut_lineage(dealt.mapInArrow(_candidate_runs(compared), "kind int, key long, a long, b long"))
    pairs = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", F.col("a").alias("node")).distinct()
    if hot.isEmpty():
        return pairs, hot
    at = F.array_position("bands", F.col("key")).cast("int")
    rest = F.concat(F.slice("bands", at + 1, F.lit(BANDS)), F.slice("bands", F.lit(1), at - 1))
    # ranges of (key, other bands) split the key of a large group over many tasks
    ordered = hot.join(nodes, "node").select("key", rest.alias("rest"), "node").repartitionByRange("key", "rest").sortWithinPartitions("key", "rest", "node")
    return pairs.unionByName(ordered.select("key", "node", "rest").mapInArrow(_hub_runs(HUBS, STRETCH), "a long, b long")), hot


def _block_links(similarity: float):
    """Over rows (key, i, j, side, node, root, shingles) sorted by (key, i, j): links
    between the nodes of side 1 and those of side 0. Pairs of different roots are
    compared on the whole sets until a link has made the roots equal, so what goes out
    spans the true links and has fewer rows than there are nodes."""

    def links(side, node, root, sets):
        sets = [np.frombuffer(x, np.uint32) for x in sets]
        order = np.argsort([len(x) for x in sets], kind="stable")
        side, node = side[order], node[order]
        sizes = np.array([len(sets[i]) for i in order], np.int64)
        _, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        label = np.unique(root[order], return_inverse=True)[1]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        present = np.zeros(len(ids), np.uint8)
        others = np.flatnonzero(side == 0)
        a, b = [], []
        for x in np.flatnonzero(side == 1):
            # of the others, those of a length that allows the similarity
            lo = np.searchsorted(sizes[others], similarity * sizes[x] - 1e-6)
            hi = np.searchsorted(sizes[others], sizes[x] / similarity + 1e-6)
            ys = others[lo:hi]
            ys = ys[label[ys] != label[x]]
            if not len(ys):
                continue
            present[ids[starts[x] : ends[x]]] = 1
            spans = np.repeat(starts[ys] - np.concatenate([[0], np.cumsum(sizes[ys])[:-1]]), sizes[ys]) + np.arange(sizes[ys].sum())
            shared = np.add.reduceat(present[ids[spans]], np.cumsum(sizes[ys]) - sizes[ys], dtype=np.int64)
            present[ids[starts[x] : ends[x]]] = 0
            for y in ys[shared >= similarity * (sizes[x] + sizes[ys] - shared)]:
                if label[y] != label[x]:
                    a.append(node[x])
                    b.append(node[y])
                    label[label == label[y]] = label[x]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            whole = whole if held is None else pa.concat_tables([held, whole])
            key = np.stack([whole.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]).tolist()
            for x, y in zip(cuts, cuts[1:]):
                yield unit(whole.slice(x, y - x))
            held = whole.slice(cuts[-1])
        if held is not None:
            yield unit(held)

    def unit(t):
        return links(*(t.column(c).to_numpy() for c in (3, 4, 5)), t.column(6).to_pylist())

    return run


def _by_prefix(groups: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(key, node): the groups cut into smaller ones, by prefix filtering. Sets of at least
    the similarity share a member of their prefixes, the first members in a common order that
    are too many to be left out. The order begins with the rarest members, so that texts
    that share a frame alone do not meet, and pairs that are alike are not lost."""

    def members(it):
        for b in it:
            sets = [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
            cat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(cat.astype(np.int64)), pa.array(np.repeat(sizes - least + 1, sizes))], names=["node", "member", "prefix"])

    mine = shingles.join(groups.select("node").distinct(), "node", "left_semi").select("node", "shingles")
    spread = cut_lineage(mine.mapInArrow(members, "node long, member long, prefix long"))
    times = spread.groupBy("member").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "member"))
    first = spread.join(times, "member").withColumn("place", place).where("place <= prefix")
    return groups.join(first.select("node", "member"), "node").select(F.xxhash64("key", "member").alias("key"), "node")


def _links_between(groups: DataFrame, roots: DataFrame, nodes: DataFrame, shingles: DataFrame, similarity: float, block: tuple[int, int] = (BLOCK_BYTES, BLOCK_NODES), wide: int | None = WIDE) -> DataFrame | None:
    """a, b: links within the groups (key, node) that join what ``roots`` (node, root)
    has not joined, as a set that spans them; None if every group is joined. The members
    outside the commonest root of their group meet all members of the group: both are
    dealt into blocks by hash, and each pair of blocks is a unit of work of its own. So
    a large group that is joined but for a few members costs in proportion to its size.
    A group with more than ``wide`` members outside, texts that share a frame and are
    not alike, is cut by prefixes of the sets first, as its blocks would be too many."""
    members = groups.join(roots, "node", "left").join(nodes.select("node", "size"), "node")
    members = members.select("key", "node", F.coalesce("root", "node").alias("root"), "size")
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    commonest = F.max_by("root", F.struct("n", F.col("root")))
    parts = lambda size, n: F.greatest(F.ceil(size * 4 / block[0]), F.ceil(n / block[1])).cast("long")
    keys = by_root.groupBy("key").agg(commonest.alias("common"), F.sum("n").alias("n"), F.sum("size").alias("s"), F.max("n").alias("n0"), F.max_by("size", F.struct("n", "root")).alias("s0"))
    keys = keys.where("n > n0").select("key", "common", parts(F.col("s"), F.col("n")).alias("whole"), parts(F.col("s") - F.col("s0"), F.col("n") - F.col("n0")).alias("outside"), (F.col("n") - F.col("n0")).alias("open"))
    dealt = cut_lineage(members.join(keys, "key").withColumn("h", F.xxhash64("node")))
    if dealt.isEmpty():
        return None
    cut = None
    if wide is not None and not dealt.where(F.col("open") > wide).isEmpty():
        cut = _links_between(_by_prefix(dealt.where(F.col("open") > wide).select("key", "node"), shingles, similarity), roots, nodes, shingles, similarity, block, None)
        dealt = dealt.where(F.col("open") <= wide)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = dealt.select("key", upto("outside").alias("i"), F.pmod("h", "whole").alias("j"), F.lit(0).alias("side"), "node", "root")
    outside = dealt.where("root <> common").select("key", F.pmod("h", "outside").alias("i"), upto("whole").alias("j"), F.lit(1).alias("side"), "node", "root")
    rows = all_.unionByName(outside).join(shingles, "node").select("key", "i", "j", "side", "node", "root", "shingles")
    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_links(similarity), "a long, b long")
    return cut_lineage(found if cut is None else found.unionByName(cut))


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY, compared: int = COMPARED) -> DataFrame:
    """doc_id, row keys, node, root for every row: rows with equal roots are copies or near
    copies, chained by pairs of at least ``similarity``. Candidates are fingerprints
    within two bits, found by their deletion variants, and, as 64 bits cannot reach
    down to the similarity, texts that share a min-wise band. Every candidate is
    verified on the whole shingle sets (32-bit hashes). Band keys of more than
    ``compared`` nodes, and components of fingerprints within two bits, are then
    compared in all pairs that are not joined yet: the links of ``links`` only span
    the components, and of texts of one fingerprint only one is paired."""
    found = cut_lineage(sketches(docs))
    nodes = cut_lineage(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    near = links(by_fp.select("fp"))
    reps_a, reps_b = by_fp.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), by_fp.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    by_bits = near.join(reps_a, "a").join(reps_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    same = nodes.join(by_fp, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    by_bands, hot = _copy_candidates(nodes, compared)
    candidates = cut_lineage(by_bands.unionByName(by_bits).unionByName(same).distinct())
    del by_bands, by_bits, same
    release_files(docs.sparkSession)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()

    def sets(it):
        for b in it:
            out = [shingle_hashes(x) for x in b.column(0).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in out], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in out], pa.binary())], names=["node", "shingles"])

    chosen = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("c")).join(wanted, "node").select(F.col("c.doc_id").alias("_c"), F.col("node").alias("_n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen.select("_c").distinct(), F.col("doc_id").eqNullSafe(F.col("_c")), "left_semi").select("text")
    shingles = cut_lineage(texts.mapInArrow(sets, "node long, shingles binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    release_files(docs.sparkSession)
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def verify(it):
        for b in it:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                small, large = (len(x), len(y)) if len(x) < len(y) else (len(y), len(x))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large else 0
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    linked = candidates.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")
    roots = cut_lineage(components(linked))
    release_files(docs.sparkSession)
    alike = components(near).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    by_component = nodes.join(alike, "fp", "left").select(F.coalesce("key", "fp").alias("key"), "node")
    more = _links_between(hot.unionByName(by_component), roots, nodes, shingles, similarity)
    if more is not None and not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return found.join(roots, "node", "left").select("doc_id", *ROW_KEYS, "node", F.coalesce("root", "node").alias("root"))


def drop_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one with the lowest id, and of
    repeated rows one. Rows with equal ids but different texts are judged by text.
    Columns of any name are kept as they are. The rows themselves are shuffled once,
    by the hashes of the rows that stay."""
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node", *ROW_KEYS))
    best = copy_groups(docs, similarity).groupBy("root").agg(lowest.alias("best")).select(*(F.col(f"best.{k}").alias(k) for k in ROW_KEYS))
    kept = _with_row_keys(docs).select("document", *ROW_KEYS).join(best, list(ROW_KEYS), "left_semi")
    one = F.row_number().over(Window.partitionBy(*ROW_KEYS).orderBy(*ROW_KEYS))
    return kept.select("document", one.alias("one")).where("one = 1").select("document.*")
