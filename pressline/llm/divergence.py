"""Source divergence audit: how far the word shares of sources of a language lie apart.

All counts come from sorted streams. A map task sorts its terms by (lang, source, term,
document) and folds each run into its documents and occurrences. Spark deals what is
left by (lang, term, source), sorts by (lang, term, source, document) and a run-length scan
adds the runs up. Dealt by the source too, a frequent term is no hot key: a key has
at most one row from each fold of a map task. The sums, one row for each term and source,
then meet by (lang, term), where document frequencies decide which terms are kept.

A second stream carries the kept counts, sorted by (lang, pair of source blocks, part,
term), and its totals come first: header rows, which sort before all terms, name the
sources of the blocks with their sums (order inversion). So a scan of one pass knows every denominator,
forms the shares of one run of terms after another, adds up the distances of all pairs
of sources, and at the end of a key emits partial sums of pairs and the best terms of each
source. Terms are dealt over parts, sources over blocks of about ``BLOCK``, so neither
a large vocabulary nor many sources meet in one task. A pair's partial sum
counts only terms that a part has seen; the value of two sources without a term is the same
for all others and is added once. All arithmetic is on integers.

Defined cases: null text, lang and source count as empty; every row is a document of its
own, also among repeated rows; ids are not used; a group without kept terms has shares of
zero counts, a language without kept terms has pairs of value 0 and no terms; ties
rank by the item's UTF-8 bytes; a very long text is cut into terms in one task; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut_lineage, table

MIN_DOCUMENTS = 10
TOP = 10
#: Terms that a map task folds at a time.
FOLD_TERMS = 5_000_000
#: Sources of one block, on average.
BLOCK = 256
#: Kept counts that one part should hold.
PART_ROWS = 50_000
#: Cells of terms by sources that are worked on at a time.
CELLS = 1_000_000
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_terms = re.compile(TERM_PATTERN).findall


class Numbers(dict):
    """Numbers values in the order in which they come."""

    def __missing__(self, x):
        n = self[x] = len(self)
        return n


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


#: ``word`` is the lang, a NUL and the term, which holds none: one column that sorts by both.
RUNS = "word string, source string, document long, documents long, n long"
_NAMES = ["word", "source", "document", "documents", "n"]


def local_runs(docs: DataFrame, fold_terms: int) -> DataFrame:
    """Runs of one lang, term and source in a map task: the first document (numbered in
    the task), the number of documents and of occurrences."""

    def run(it):
        first = TaskContext.get().partitionId() << 40
        done = 0  # documents folded before
        words, groups, texts, held = Numbers(), Numbers(), [], 0

        def fold():
            sizes = np.array([len(t) for _, t in texts])
            term = np.concatenate([t for _, t in texts])
            group = np.repeat(np.array([g for g, _ in texts]), sizes)
            document = np.repeat(np.arange(len(texts)), sizes)
            key = np.sort((group * len(words) + term) * len(texts) + document)
            at = _starts(key)
            times = np.diff(np.r_[at, len(key)])
            pair, document = np.divmod(key[at], len(texts))
            runs = _starts(pair)
            group, term = np.divmod(pair[runs], len(words))
            names, spelled = list(groups), pa.array(list(words), pa.string())
            lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            out = [first + done + document[runs], np.diff(np.r_[runs, len(pair)]), np.add.reduceat(times, runs)]
            for lo in range(0, len(runs), 50_000):
                g, t = (pa.array(x[lo : lo + 50_000]) for x in (group, term))
                word = pc.binary_join_element_wise(lang.take(g), spelled.take(t), "\0")
                yield pa.RecordBatch.from_arrays([word, source.take(g), *(pa.array(c[lo : lo + 50_000]) for c in out)], names=_NAMES)

        for b in it:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = _terms(ascii_lower(text))
                if found:
                    texts.append((groups[lang, source], np.fromiter(map(words.__getitem__, found), np.int64, len(found))))
                    held += len(found)
                if held >= fold_terms:
                    yield from fold()
                    done += len(texts)
                    words, groups, texts, held = Numbers(), Numbers(), [], 0
        if texts:
            yield from fold()

    return docs.mapInArrow(run, RUNS)


def _added_up(it):
    """Run-length scan: sums of sorted rows of equal lang, term and source; a run that a
    batch cuts off is carried into the next one."""

    def rows(batch, at):
        sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), at)) for c in ("documents", "n")]
        heads = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(heads.column(c) for c in _NAMES[:3]), *sums], names=_NAMES)

    def runs(batch):
        new = np.ones(batch.num_rows, bool)
        n = batch.num_rows - 1
        different = [pc.not_equal(c.slice(1), c.slice(0, n)).to_numpy(zero_copy_only=False) for c in (batch.column(x) for x in ("word", "source"))]
        new[1:] = different[0] | different[1]
        return np.flatnonzero(new)

    carried = None
    for b in it:
        if not b.num_rows:
            continue
        if carried is not None:
            b = pa.concat_batches([carried, b])
        folded = rows(b, runs(b))
        carried = folded.slice(folded.num_rows - 1)
        if folded.num_rows > 1:
            yield folded.slice(0, folded.num_rows - 1)
    if carried is not None:
        yield carried


def kept_counts(docs: DataFrame, min_documents: int, fold_terms: int) -> DataFrame:
    """lang, term, source, n, total (of the lang), head (first source of its term): the
    counts of terms in at least ``min_documents`` documents of their lang."""
    dealt = local_runs(docs, fold_terms).repartition("word", "source").sortWithinPartitions("word", "source", "document")
    sums = dealt.mapInArrow(_added_up, RUNS)
    run = Window.partitionBy("word").orderBy("source")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = sums.select("word", "source", "n", F.sum("documents").over(whole).alias("frequency"), F.sum("n").over(whole).alias("total"), (F.row_number().over(run) == 1).alias("head"))
    term = F.substring_index("word", "\0", -1)
    lang = F.expr("left(word, length(word) - length(term) - 1)")
    return cut_lineage(counted.where(F.col("frequency") >= min_documents).select(term.alias("term"), "word", "source", "n", "total", "head").select(lang.alias("lang"), "term", "source", "n", "total", "head"))


# ---- distances --------------------------------------------------------------------


def shares(counts: np.ndarray, sums: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (sum + 2 terms)), by long division in steps of a thousand."""
    m = sums.astype(np.uint64) + np.uint64(2 * terms)
    rest = counts.astype(np.uint64) + np.uint64(2)
    out = np.zeros(np.broadcast_shapes(rest.shape, m.shape), np.uint64)
    for _ in range(3):
        rest = rest * np.uint64(1000)
        digit = rest // m
        out = out * np.uint64(1000) + digit
        rest = rest - digit * m
    return out + np.uint64(1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.where(p > q, p - q, q - p)
    return d * d // (p + q)


class Key:
    """The stream of one language, pair of blocks and part."""

    def __init__(self, lang: str, low: int, high: int, part: int, top: int):
        self.lang, self.low, self.high, self.part, self.top = lang, low, high, part, top
        self.sources: list[str] = []
        self.blocks: list[int] = []
        self.sums: list[int] = []
        self.rest: pa.Table | None = None
        self.order = 0  # terms seen
        self.pairs: np.ndarray | None = None
        self.best: list[list[tuple[int, int, str]]] = []

    def headers(self, t: pa.Table) -> None:
        self.sources += t.column("source").to_pylist()
        self.blocks += t.column("block").to_pylist()
        self.sums += t.column("n").to_pylist()
        self.total, self.terms = t.column("total")[0].as_py(), t.column("terms")[0].as_py()

    def start(self) -> None:
        self.slot = {s: i for i, s in enumerate(self.sources)}
        self.n = np.array(self.sums, np.int64)
        of = np.array(self.blocks)
        self.left, self.right = np.flatnonzero(of == self.low), np.flatnonzero(of == self.high)
        self.zero = shares(np.zeros(len(self.n), np.int64), self.n, self.terms) if self.terms else np.ones(len(self.n), np.uint64)
        self.none = np.stack([distance(self.zero[i], self.zero[self.right]) for i in self.left]) if len(self.left) else np.zeros((0, len(self.right)), np.uint64)
        self.pairs = (self.none * np.uint64(self.terms if self.part == 0 else 0)).astype(np.int64)
        self.best = [[] for _ in self.sources]

    def add(self, t: pa.Table) -> None:
        """Rows of terms; the last term waits, as more of its rows may come."""
        if self.pairs is None:
            self.start()
        t = t if self.rest is None else pa.concat_tables([self.rest, t])
        term = t.column("term").combine_chunks()
        n = len(term) - 1
        new = np.r_[True, pc.not_equal(term.slice(1), term.slice(0, n)).to_numpy(zero_copy_only=False)]
        last = int(np.flatnonzero(new)[-1])
        self.rest = t.slice(last)
        if last:
            self.terms_of(t.slice(0, last), np.flatnonzero(new[:last]))

    def terms_of(self, t: pa.Table, heads: np.ndarray) -> None:
        names = t.column("term").take(pa.array(heads)).to_pylist()
        totals = t.column("total").to_numpy()[heads]
        coded = t.column("source").combine_chunks().dictionary_encode()
        slot = np.array([self.slot[s] for s in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, t.num_rows]))
        n = t.column("n").to_numpy()
        step = max(1, CELLS // len(self.sources))
        for lo in range(0, len(heads), step):
            hi = min(lo + step, len(heads))
            mine = (row >= lo) & (row < hi)
            counts = np.zeros((hi - lo, len(self.sources)), np.int64)
            counts[row[mine] - lo, slot[mine]] = n[mine]
            p = shares(counts, self.n, self.terms)
            right = p[:, self.right]
            for k, i in enumerate(self.left):
                self.pairs[k] += (distance(p[:, i, None], right).sum(axis=0) - self.none[k] * np.uint64(hi - lo)).astype(np.int64)
            if self.low == self.high:
                self.best_of(names[lo:hi], counts, p, shares(totals[lo:hi], np.int64(self.total), self.terms))
            self.order += hi - lo

    def best_of(self, names: list[str], counts: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        for i in range(len(self.sources)):
            at = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            value = distance(p[at, i], q[at]).astype(np.int64)
            chosen = np.lexsort((at, -value))[: self.top]  # terms come in the order of their bytes
            self.best[i] = sorted([*self.best[i], *((-int(value[c]), self.order + int(at[c]), names[at[c]]) for c in chosen)])[: self.top]

    def results(self) -> pa.Table:
        if self.pairs is None:
            self.start()
        if self.rest is not None:
            self.terms_of(self.rest, np.array([0]))
        rows = [(self.sources[i], "term", name, -v) for i, best in enumerate(self.best) for v, _, name in best]
        for k, i in enumerate(self.left):
            rows += [(self.sources[i], "pair", self.sources[j], int(v)) for j, v in zip(self.right, self.pairs[k]) if self.low != self.high or i < j]
        source, kind, item, value = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"lang": pa.array([self.lang] * len(rows), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(kind, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


STREAM = ["lang", "low", "high", "deal", "kind", "term", "source", "block", "n", "total", "terms"]


def _partial_results(top: int):
    def run(it):
        key = None
        for b in it:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            of = [t.column(c).to_numpy() for c in ("low", "high", "deal", "kind")]
            lang = t.column("lang").combine_chunks().dictionary_encode()
            at = _starts(lang.indices.to_numpy(), *of)
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), t.num_rows]):
                here = (lang.dictionary[lang.indices[lo].as_py()].as_py(), *(int(c[lo]) for c in of[:3]))
                if key is None or (key.lang, key.low, key.high, key.part) != here:
                    if key is not None:
                        yield from key.results().to_batches()
                    key = Key(*here, top)
                (key.add if of[3][lo] else key.headers)(t.slice(lo, hi - lo))
        if key is not None:
            yield from key.results().to_batches()

    return run


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, fold_terms: int = FOLD_TERMS, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; ``docs`` has text, lang and source."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = kept_counts(named, min_documents, fold_terms)
    by_lang = counts.groupBy("lang").agg(F.sum(F.col("head").cast("long")).alias("terms"), F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = cut_lineage(groups.na.fill(0, ["n", "total", "terms"]))
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    rows = counts.count()
    blocks = math.ceil(sources / block)
    parts = max(1, math.ceil(rows / max(part_rows, min(sources, block) ** 2)))  # partial sums stay fewer than counts
    in_block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    meets = F.explode(F.expr(f"transform(sequence(0, {blocks - 1}), o -> named_struct('low', least(block, o), 'high', greatest(block, o)))"))
    deals = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none, zero = F.lit(""), F.lit(0).cast("long")
    headers = groups.withColumn("block", in_block).withColumn("pair", meets).withColumn("deal", deals).select("lang", "pair.low", "pair.high", "deal", F.lit(0).alias("kind"), none.alias("term"), "source", "block", "n", "total", "terms")
    data = counts.withColumn("block", in_block).withColumn("pair", meets).select("lang", "pair.low", "pair.high", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("deal"), F.lit(1).alias("kind"), "term", "source", "block", "n", "total", zero.alias("terms"))
    stream = headers.unionByName(data).repartition("lang", "low", "high", "deal").sortWithinPartitions("lang", "low", "high", "deal", "kind", "term", "source")
    partial = cut_lineage(stream.select(*STREAM).mapInArrow(_partial_results(top), "lang string, source string, part string, item string, value long"))
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "part", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    found = both.select("lang", "x.source", "part", "x.item", "value").unionByName(partial.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    return found.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with doc as (
    select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') as ts from documents),
place as (select rid, lang, source, unnest(ts) as term from doc),
kept as (select lang, term, count(*) as total from place group by lang, term having count(distinct rid) >= {MIN_DOCUMENTS}),
lang_sum as (select lang, count(*)::hugeint as v, sum(total) as n from kept group by lang),
grp as (select distinct lang, source from doc),
cnt as (select lang, source, term, count(*) as c from place join kept using (lang, term) group by all),
grp_sum as (select lang, source, coalesce(sum(c), 0) as n from grp left join cnt using (lang, source) group by all),
share as (
    select g.lang, g.source, k.term, coalesce(c, 0) as c,
           1 + (1000000000::hugeint * (coalesce(c, 0) + 2)) // (g.n + 2 * v) as p,
           1 + (1000000000::hugeint * (k.total + 2)) // (l.n + 2 * v) as q
    from grp_sum g join kept k using (lang) join lang_sum l using (lang) left join cnt using (lang, source, term)),
pair as (
    select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join share x on x.lang = a.lang and x.source = a.source
    left join share y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
term as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from share where c > 0 and p > q),
found as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
where part = 'pair' or rank <= {TOP}
"""
