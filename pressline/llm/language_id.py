"""Language identification by hierarchical discrimination.

A text is a vector of square-root frequencies of hashed byte n-grams of its letters.
Linear support vector machines, one versus one, first choose the language family
and then the language within it, where close relatives only compete with each
other. Each pair of classes is trained in its own Spark task on a sample of at most
``SAMPLE`` labelled documents per class, chosen by the hash of the id; a family's share
is divided evenly among its languages. So a task holds at most twice ``SAMPLE`` vectors,
however many languages there are; they are dealt out ``STEP`` at a time. The vectors stay on
the executors' disks until the machines are there: files of the checkpoint folder would be as
many as the shuffle has partitions, nearly all of them empty.

Defined cases: a null text and one without letters (Unicode categories L*) are ``und``
with score 0; so is every text if nothing can be learned; with a single language that
one is predicted; null labels and held-out documents teach nothing; texts of any length
are read whole, piece by piece; ties go to the larger sum of margins, then by name;
repeated rows are predicted row by row; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, table

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Bound of the labelled documents per class (language or family) that a machine is fitted on.
SAMPLE = 1000
DIM = 1 << 13
#: Vectors in one Arrow batch (4 MB).
STEP = 256
EPOCHS = 150
L2 = 1e-4
#: Characters counted at a time; whole texts are counted piece by piece.
PIECE = 1 << 20

#: Families of common languages (fixed values); others are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa mr gu ne",
    "iranian": "fa ku ps tg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Characters that count as part of a word and are no letters, such as fractions and Roman numerals.
NUMBERS = {c: " " for c in range(0x80, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()}
_NUMBERS = frozenset(map(chr, NUMBERS))


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the text's byte n-grams (one to three bytes of its lower-cased
    letters, word ends marked); None without letters."""
    counts = np.zeros(DIM, np.int64)
    total = 0
    text = text or ""
    for at in range(0, len(text), PIECE):
        letters = NOT_LETTERS.sub(" ", text[at : at + PIECE].lower())
        letters = (letters if letters.isascii() or _NUMBERS.isdisjoint(letters) else letters.translate(NUMBERS)).strip()
        if not letters:
            continue
        b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
        for h in (b * np.uint32(0x165667B1), two, three):
            counts += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13), minlength=DIM)
        total += len(b)
    if not total:
        return None
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def train_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine (squared hinge loss,
    classes weighted alike), by accelerated gradient descent. ``x`` is not copied; the
    offset is the last weight, that of a column of ones."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, t = w.copy(), 1.0
    step = 1.0 / (2 * 2.0 + L2)
    for _ in range(EPOCHS):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * each * y * slack
        gradient = np.append(x.T @ pull, pull.sum()) + L2 * ahead
        new = (ahead - step * gradient).astype(np.float32)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = (new + (t - 1) / t_new * (new - w)).astype(np.float32)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, text: at most ``sample`` training documents of each language, those
    with the lowest hash. A filter by each language's count comes first, so that
    the ranking sees a few times the sample only."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("doc_id", FOLDS) != HELD_OUT))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(2.0) * sample / F.col("n") + F.lit(50.0) / F.col("n")
    few = known.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "rank", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: languages by family, and the machine of each pair of families and
    of each pair of languages in a family."""
    examples = _vectors(labelled_sample(docs, sample)).persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(examples, sample)
    finally:
        examples.unpersist()


def _fitted(examples: DataFrame, sample: int) -> dict:
    langs = sorted(r["lang"] for r in examples.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family(lang), []).append(lang)
    pairs = [("family", a, b) for a, b in combinations(sorted(families), 2)]
    pairs += [("lang", a, b) for members in families.values() for a, b in combinations(members, 2)]
    model = {"families": families, "machines": {}}
    if not pairs:
        return model
    # by language the duels it takes part in, and up to which rank its documents do
    wanted: dict[str, list[tuple[int, tuple[str, str, str, int]]]] = {lang: [] for lang in langs}
    for level, a, b in pairs:
        for lang in langs:
            name = family(lang) if level == "family" else lang
            if name in (a, b):
                limit = sample if level == "lang" else -(-sample // len(families[name]))
                wanted[lang].append((limit, (level, a, b, 1 if name == a else -1)))

    def fit(group: pa.Table) -> pa.Table:
        x = np.empty((group.num_rows, DIM), np.float32)
        for row, v in zip(x, group.column("x")):
            row[:] = np.frombuffer(v.as_buffer(), np.float16)
        w, offset = train_pair(x, group.column("y").to_numpy().astype(np.float32))
        return pa.Table.from_arrays([*(group.column(c).slice(0, 1) for c in ("level", "a", "b")), pa.array([w.tobytes()], pa.binary()), pa.array([offset])], names=["level", "a", "b", "w", "offset"])

    dealt = examples.mapInArrow(lambda it: deal(it, wanted), "level string, a string, b string, y int, x binary")
    for r in dealt.groupBy("level", "a", "b").applyInArrow(fit, "level string, a string, b string, w binary, offset double").collect():
        model["machines"][r["level"], r["a"], r["b"]] = (np.frombuffer(bytes(r["w"]), np.float32), r["offset"])
    return model


def deal(it: Iterator[pa.RecordBatch], wanted: dict) -> Iterator[pa.RecordBatch]:
    """The vectors of each duel that ``wanted`` has for their language, at most ``STEP`` in a batch."""
    for batch in it:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            for lang in part.column(0).unique().to_pylist():
                own = part.filter(pc.equal(part.column(0), lang))
                for limit, (level, a, b, y) in wanted[lang]:
                    x = own.filter(pc.less_equal(own.column(1), limit)).column(2)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([*(pa.repeat(c, len(x)) for c in (level, a, b, pa.scalar(y, pa.int32()))), x], names=["level", "a", "b", "y", "x"])


def _vectors(texts: DataFrame) -> DataFrame:
    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, STEP):
                b = batch.slice(at, STEP)
                x = [None if f is None else f.astype(np.float16).tobytes() for f in map(features, b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["lang", "rank", "x"])

    return texts.mapInArrow(run, "lang string, rank int, x binary").where("x is not null")


class Classifier:
    def __init__(self, model: dict):
        self.families = model["families"]
        self.pairs = sorted(model["machines"])
        self.w = np.stack([model["machines"][p][0] for p in self.pairs]) if self.pairs else np.zeros((0, DIM), np.float32)
        self.offset = np.array([model["machines"][p][1] for p in self.pairs])

    def _choose(self, level: str, names: list[str], margins: dict) -> tuple[str, float]:
        """The class with most duels won, then the larger sum of margins, then by
        name; and the weakest confidence among its duels."""
        if len(names) == 1:
            return names[0], 1.0
        wins, sums, least = (dict.fromkeys(names, v) for v in (0, 0.0, 1.0))
        for a, b in combinations(names, 2):
            m = margins[level, a, b]
            confidence = 1 / (1 + np.exp(-4 * m))
            wins[a if m >= 0 else b] += 1
            for c, s, p in ((a, m, confidence), (b, -m, 1 - confidence)):
                sums[c] += s
                least[c] = min(least[c], p)
        best = min(names, key=lambda c: (-wins[c], -sums[c], c))
        return best, float(least[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        margins = dict(zip(self.pairs, (self.w @ x + self.offset).tolist()))
        group, p = self._choose("family", sorted(self.families), margins)
        lang, q = self._choose("lang", self.families[group], margins)
        return lang, min(1.0, max(0.0, p * q))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every whole text; a narrow pass. The model goes
    to the tasks once each; its size is bounded by the pairs of languages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        c = Classifier(sent.value)
        for b in it:
            found = [c.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
