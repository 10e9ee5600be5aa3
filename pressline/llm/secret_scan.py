"""Secret scans with a randomness test battery.

Known shapes (assignments, access keys, long hex runs) are found by pattern. Any
other long token gets an inferred encoding (the smallest alphabet that holds it)
and three tests of the hypothesis that its symbols were drawn uniformly from that
alphabet: chi-squared over the symbols and over their classes, a runs test about
the middle of the alphabet, and the lag-one serial correlation. The combined
p-value is uniform for random strings and near zero for words.

Which p-values to accept is decided per encoding and length band over the whole
table: the p-values of a band are a mixture of random strings, with a flat
distribution, and of others, whose p-values crowd near zero the more the longer the
strings are. The mixture is fitted by expectation-maximisation from a prior measured
on joined words, which decides where a band holds few strings and fades where it holds
many. The lowest threshold is taken at which the share of other strings among the
accepted ones is estimated to stay under ``FALSE_SHARE``. Equal strings count once.

Defined cases: a null text is empty and has no span; texts of any length are scanned
whole, in time that grows with the length; a span never overlaps one of a known shape;
equal strings are treated alike wherever they stand; repeated rows are reported row by
row; an empty table gives an empty result; further input columns are ignored, whatever
their names (``redact`` keeps them and reads the texts twice, once for the thresholds).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the smallest alphabet on (fixed values).
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32_lower", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: From this encoding on, a dash may be a symbol.
WITH_DASHES = [name for name, _ in ENCODINGS].index("base62")
#: Lower ends of the length bands.
BANDS = (20, 24, 32, 48, 64, 96)
THRESHOLDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
FALSE_SHARE = 0.05
#: Prior of the p-values of other strings, measured on joined words: the share above the
#: lowest threshold by length band, and what part of it lies above each threshold.
OTHERS_ABOVE = (0.03, 0.015, 0.003, 0.001, 0.001, 0.001)
OTHERS_TAIL = (1.0, 0.85, 0.72, 0.67, 0.58, 0.45, 0.35, 0.27, 0.18, 0.11, 0.07)
#: Strings that the prior weighs as much as, and rounds of the fit.
PRIOR_STRINGS, ROUNDS = 50.0, 100
REDACTED = "[SECRET]"


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the known shapes, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(token: str) -> int | None:
    symbols = set(token)
    for i, (_, alphabet) in enumerate(ENCODINGS):
        if symbols <= set(alphabet):
            return i
    return None


def randomness(token: str, encoding: int) -> float:
    """Combined p-value of the battery; 0 for tokens of a single symbol."""
    alphabet = ENCODINGS[encoding][1]
    k, n = len(alphabet), len(token)
    x = np.array([alphabet.index(c) for c in token], np.float64)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    if counts.max() == n:
        return 0.0
    chi = (counts.astype(np.float64) ** 2).sum() * k / n - n
    p_symbols = _tail((chi - (k - 1)) / math.sqrt(2.0 * (k - 1) * (n - 1) / n))
    classes = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in alphabet])
    share = np.bincount(classes, minlength=4) / k
    seen = np.bincount(classes, weights=counts, minlength=4)
    used = share > 0.05
    df = used.sum() - 1
    chi = ((seen[used] - n * share[used]) ** 2 / (n * share[used])).sum()
    p_classes = 1.0 if df < 1 else math.exp(-chi / 2) if df == 2 else math.erfc(math.sqrt(chi / 2))
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 and n0:
        mean = 1 + 2.0 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - (k - 1) / 2
    r = (d[1:] * d[:-1]).sum() / (d * d).sum()
    p_serial = 2 * _tail(abs(r) * math.sqrt(n))
    ps = [min(1.0, max(p, 1e-300)) for p in (p_symbols, p_classes, p_runs, p_serial)]
    # Fisher's combination; the four statistics are close to independent under uniformity
    half = -sum(map(math.log, ps))
    return min(1.0, math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6))


def joined_spans(known: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans in order, overlapping ones joined."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in known:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(start, end, encoding, band, p) of long tokens outside the known spans. Groups
    set off by dashes, as in a UUID, are tested without the dashes."""
    out = []
    starts, ends = joined_spans(known)
    for m in TOKEN.finditer(text):
        a, b = m.span()
        token = m[0]
        if token.isalpha() and (token.islower() or token[1:].islower() or token.isupper()):
            continue  # one word in one case
        before = bisect_right(starts, b - 1) - 1
        if before >= 0 and ends[before] > a:
            continue
        core = token.strip("=-_")
        bare = core.replace("-", "")
        if len(bare) < BANDS[0]:
            bare = core
        if len(bare) < BANDS[0]:
            continue
        encoding = infer_encoding(bare)
        if encoding is None or (bare != core and encoding >= WITH_DASHES):
            bare, encoding = core, infer_encoding(core)
        if encoding is None:
            continue
        a += token.index(core)
        band = sum(len(bare) >= low for low in BANDS) - 1
        out.append((a, a + len(core), encoding, band, randomness(bare, encoding)))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("band", pa.int32()), ("p", pa.float64()), ("digest", pa.int64())])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and tested candidates of each whole text; a narrow pass."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"]

    def run(it):
        for b in it:
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                text = text or ""
                base = known_spans(text)
                row = [sum(k == i for _, k, _ in base) for i in range(3)]
                row.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                row.append([dict(start=a, rank=k, end=e) for a, k, e in base])
                row.append([
                    dict(start=a, end=e, encoding=c, band=d, p=p, digest=int.from_bytes(hashlib.blake2b(text[a:e].encode(), digest_size=8).digest(), "big", signed=True))
                    for a, e, c, d, p in candidates(text, base)
                ])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(_SPAN), pa.list_(_CANDIDATE)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,rank:int,end:long>>, candidates array<struct<start:long,end:long,encoding:int,band:int,p:double,digest:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def lowest_accepted(above: np.ndarray, band: int) -> float | None:
    """The threshold for a band with ``above[i]`` distinct strings of p over THRESHOLDS[i - 1]
    (all of them at 0); None if none is good enough."""
    cells = -np.diff(above, append=0).astype(np.float64)
    flat = -np.diff(np.concatenate([[1.0], 1 - np.array(THRESHOLDS), [0.0]]))
    prior = -np.diff(np.concatenate([[1.0], OTHERS_ABOVE[band] * np.array(OTHERS_TAIL), [0.0]]))
    share, others = 0.5, prior
    for _ in range(ROUNDS):
        random = cells * (share * flat) / (share * flat + (1 - share) * others)
        share = (random.sum() + 1) / (cells.sum() + 2)
        rest = cells - random
        others = (rest + PRIOR_STRINGS * prior) / (rest.sum() + PRIOR_STRINGS)
    for i, t in enumerate(THRESHOLDS, 1):
        false, true = (1 - share) * others[i:].sum(), share * flat[i:].sum()
        if false <= FALSE_SHARE * (false + true):
            return t
    return None


def thresholds(scanned: DataFrame) -> dict[tuple[int, int], float]:
    """(encoding, band) -> lowest accepted p-value. Reads the histogram of p-values
    of distinct strings, which has a fixed number of cells."""
    c = F.explode("candidates").alias("c")
    strings = scanned.where("size(candidates) > 0").select(c).select("c.*").groupBy("encoding", "band", "digest").agg(F.max("p").alias("p"))
    cell = F.size(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: F.col("p") > t)).alias("cell")
    rows = strings.groupBy("encoding", "band", cell).count().collect()  # at most encodings x bands x thresholds
    above: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        above.setdefault((r["encoding"], r["band"]), np.zeros(len(THRESHOLDS) + 1, np.int64))[: r["cell"] + 1] += r["count"]
    found = {key: lowest_accepted(v, key[1]) for key, v in above.items()}
    return {key: t for key, t in found.items() if t is not None}


def accepted(limits: dict[tuple[int, int], float]):
    """Column: the spans of accepted candidates."""
    if not limits:
        return F.expr("cast(array() as array<struct<start:long,rank:int,end:long>>)")
    cases = " ".join(f"when c.encoding = {e} and c.band = {b} then c.p > {t}D" for (e, b), t in sorted(limits.items()))
    return F.expr(f"transform(filter(candidates, c -> case {cases} else false end), c -> named_struct('start', c.start, 'rank', {len(KINDS) - 1}, 'end', c.end))")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the known shapes, and all spans in order."""
    scanned = cut_lineage(scan(docs))
    spans = F.array_sort(F.concat("base", accepted(thresholds(scanned))))
    kinds = F.array(*map(F.lit, KINDS))
    written = F.transform("all", lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return scanned.withColumn("all", spans).withColumn("spans", F.array_join(written, ","))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact_text(text: str, limits: dict[tuple[int, int], float]) -> str:
    base = known_spans(text)
    spans = [(a, b) for a, _, b in base] + [(a, e) for a, e, c, d, p in candidates(text, base) if p > limits.get((c, d), 2.0)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced; n_chars follows the text."""
    limits = thresholds(scan(docs))
    text_at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(it):
        for b in it:
            old = b.column(text_at).to_pylist()
            new = [None if x is None else redact_text(x, limits) for x in old]
            cols = list(b.columns)
            cols[text_at] = pa.array(new, b.schema.field(text_at).type)
            if counted is not None:
                was = b.column(counted).to_pylist()
                cols[counted] = pa.array([w if x == y or y is None else len(y) for w, x, y in zip(was, old, new)], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
