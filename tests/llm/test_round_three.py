"""Divergence, license scans and resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressline.llm import decontaminate, divergence, license_scan, resample, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside, as further columns of the documents.
INNER = ["k1", "k2", "times", "words", "places", "spans", "best", "n", "total", "head", "block", "deal", "kind", "term", "terms", "item", "value", "rank", "score", "weight", "above", "range", "fit", "n_words", "document", "documents"]


def texts(n, rng):
    words = "alpha beta Gamma délta ÉCLAIR z2 the of and rivers don't 東京".split()
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))) for _ in range(n)]


def corpus(rng, n=60):
    rows = [(i, x, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "z"])) for i, x in enumerate(texts(n, rng))]
    return [*rows, (7, "the the the", "en", "a"), (7, "the the the", "en", "a"), (None, None, "en", "only"), (None, "", "xx", "q"), (9, "rare words here", "xx", "r"), (10, "the " * 5000, "de", "z")]


# ---- 11


def brute_divergence(rows, least, top):
    named = [(lang or "", source or "", re.findall(divergence.TERM_PATTERN, (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in named}:
        docs = [r for r in named if r[0] == lang]
        frequency = Counter(t for _, _, ts in docs for t in set(ts))
        kept = [t for t, n in frequency.items() if n >= least]
        counts = {s: Counter() for s in {r[1] for r in docs}}
        for _, s, ts in docs:
            counts[s].update(t for t in ts if t in set(kept))
        every = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(f(share(c, t), share(o, t)) for t in kept), x.encode(), x) for x, o in counts.items() if x != s]
            terms = [(-f(share(c, t), share(every, t)), t.encode(), t) for t in kept if c[t] > 0 and share(c, t) > share(every, t)]
            out |= {(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("least,top,limits", [(3, 10, {}), (10, 2, {"fold_terms": 20, "part_rows": 1, "block": 1}), (2, 3, {"fold_terms": 1, "part_rows": 4, "block": 2}), (10**6, 10, {})])
def test_divergence(spark, least, top, limits):
    rows = corpus(random.Random(least))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.divergence(df, least, top, **limits).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_divergence(rows, least, top)


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 10**14)
        c, v = rng.randint(0, n), rng.randint(1, 10**9)
        assert int(divergence.shares(np.array([c]), np.array([n]), v)[0]) == 1 + 10**9 * (c + 2) // (n + 2 * v)


# ---- 12


def test_licenses(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 60)
    words = mit.split()
    texts = [
        "some words RELEASED under the MIT license, more", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights\nreserved", "all rights are reserved, cc of by", mit,
        " ".join([*words[:8], "really", *words[8:14], *words[15:]]), "x " * 500 + mit + " y" * 500 + " " + mit, " ".join(words[:8]), "released under the apache license", "CC BY", "GNU Lesser General Public License and more", None, "", "cc", "İ CC-BY", "ccby cc byx",
    ]
    rows = license_scan.op12_columns(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    r = {x.doc_id: x for x in rows}
    assert [r[i].labels for i in range(len(texts))] == ["mit", "cc-by,cc-by-nc", "gpl", "reserved", "", "mit", "mit", "mit", "", "", "cc-by", "gpl,lgpl", "", "", "", "cc-by", ""]
    assert [(r[i].n_base, r[i].first_word, r[i].last_word) for i in (1, 2, 3, 4, 10, 16)] == [(1, 2, 2), (1, 7, 7), (1, 0, 0), (0, None, None), (1, 0, 0), (0, None, None)]
    assert r[0].score == r[5].score == r[7].score == 1 and 0.75 <= r[6].score < 1 and 0 < r[8].score < 0.75 and r[12].score == r[13].score == r[14].score == 0
    spans = {x.doc_id: x.spans for x in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s.first, s.after) for s in spans[7] if s.label == "mit"] == [(500, 500 + len(re.findall(r"\w+", mit))), (1000 + len(re.findall(r"\w+", mit)), 1000 + 2 * len(re.findall(r"\w+", mit)))]


def test_licenses_by_other_templates(spark):
    """Random inserts, left-out and replaced words: labels and shares against a slow scan."""
    rng = random.Random(5)
    alphabet = [f"w{i}" for i in range(40)]
    templates = [(f"t{i}", " ".join(rng.choices(alphabet, k=rng.randint(4, 12)))) for i in range(5)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(templates)[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(["odd", "odd odd", ""])
            parts += [*rng.choices(alphabet, k=rng.randint(0, 6)), *t]
        docs.append((i, " ".join(parts)))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, {"w1 w2": "pair", "w3": "one"}).collect()}
    for i, text in docs:
        w = text.split()
        best, labels = 0.0, set()
        for label, template in templates:
            t = template.split()
            votes = {}
            for a in range(len(w) - 2):
                for b in range(len(t) - 2):
                    if w[a : a + 3] == t[b : b + 3]:
                        votes.setdefault(a - b, []).append((a, b))
            chain, last = [], None
            for d in [*sorted(votes), None]:
                if chain and (d is None or d - last > license_scan.GAP):
                    covered = {b + k for _, b in chain for k in range(3)}
                    share, length = len(covered) / len(t), max(a for a, _ in chain) + 3 - min(a for a, _ in chain)
                    best = max(best, share)
                    if share >= license_scan.COVERED and len(covered) / length >= license_scan.DENSE:
                        labels.add(label)
                    chain = []
                if d is not None:
                    chain, last = chain + votes[d], d
        places = sorted([(a, "pair") for a in range(len(w) - 1) if w[a : a + 2] == ["w1", "w2"]] + [(a, "one") for a in range(len(w)) if w[a] == "w3"])
        assert sorted((p.at, p.label) for p in got[i].places) == places
        assert {s.label for s in got[i].spans} == labels
        assert got[i].score == pytest.approx(1.0 if places else best)


# ---- 13


def brute_resample(rows, target, ngrams, buckets, least, percent):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in xs for b in found(x)[1]) for xs in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, fit = [], []
    for d, text, *_ in rows:
        n, bs = found(text)
        h = int(hashlib.sha256(f"{resample.SEED}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            fit.append(out[-1])
    for k, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))[: percent * len(fit) // 100], 1):
        row[4] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("ngrams,buckets,least,percent,ranges", [(1, 50, 20, 10, 512), (2, 97, 5, 50, 3), (1, 1, 1, 100, 2), (1, 50, 10**6, 10, 8), (3, 50, 0, 90, 4)])
def test_resampling(spark, ngrams, buckets, least, percent, ranges):
    rng = random.Random(percent)
    rows = [*corpus(rng, 80), *[(3, "alpha " * 30, "en", "a")] * 40, *[(3, "beta " * 30, "en", "a")] * 5, (3, "alpha " * 31, "en", "a")]
    target = [*texts(5, rng), None, ""]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), ngrams, buckets, resample.SEED, least, percent, ranges).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, ngrams, buckets, least, percent)


# ---- odd rows


def test_empty_tables_and_clashing_names(spark):
    rows = corpus(random.Random(2), 10)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(7).alias(c) for c in INNER))
    target = spark.createDataFrame([("alpha beta", 1)], "text string, bucket int")
    runs = {
        "divergence": lambda d: divergence.divergence(d, 2), "licenses": license_scan.scan, "resampling": lambda d: resample.resample(d, target),
    }
    for name, run in runs.items():
        assert run(docs.limit(0)).count() == 0, name
        n = run(docs).count()
        assert n == (len(rows) if name != "divergence" else len(brute_divergence(rows, 2, 10))), name
    assert resample.resample(docs, target.limit(0)).count() == len(rows)


def test_repeated_rows(spark):
    """Very many equal rows, and one very long text."""
    text = "All rights reserved. Released under the MIT License. " + "word " * 30
    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    long = spark.createDataFrame([(6, "tail of words " * 200_000 + text, "en", "b")], SCHEMA)
    both = docs.unionByName(long)
    assert license_scan.op12_columns(license_scan.scan(both)).groupBy("doc_id", "labels").count().orderBy("doc_id").collect() == [(5, "mit,reserved", 100_000), (6, "mit,reserved", 1)]
    drawn = resample.resample(both, spark.createDataFrame([("word",)], "text string")).where("rank is not null")
    assert sorted(r[0] for r in drawn.select("rank").collect()) == list(range(1, 100_001 * 10 // 100 + 1))
    assert {(r.source, r.part) for r in divergence.divergence(both).collect()} >= {("a", "pair"), ("b", "pair")}


# ---- suffix-array dedup on rows that are hard to tell apart


def test_suffix_dedup_of_clashing_null_ids(spark):
    """Different texts without ids that agree in 31 bits of their hash, one of them with a copy."""
    texts = spark.range(300_000).select(F.concat_ws("", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{i}")), 256) for i in range(5))).alias("text"))
    short = texts.withColumn("h", F.expr("xxhash64(text) & 2147483647"))
    clashing = short.groupBy("h").agg(F.collect_list("text").alias("ts")).where("size(ts) > 1").limit(25).collect()
    assert len(clashing) >= 10
    rows = [(None, t) for r in clashing for t in r.ts[:2]] + [(5, r.ts[0]) for r in clashing] + [(6, t) for r in clashing[:5] for t in r.ts[:2]]
    got = Counter(tuple(r)[:4] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    times = Counter(t for _, t in rows)
    assert got == Counter((d, 320, 320 if times[t] > 1 else 0, int(times[t] > 1)) for d, t in rows)


@pytest.mark.parametrize("limits", [{}, {"max_pieces": 3}])
def test_suffix_dedup_of_repeated_rows(spark, limits):
    """Very many rows of equal id and text; work is in proportion to them."""
    import time

    rng = random.Random(8)
    text, other = ("".join(rng.choice("abcdef ghi") for _ in range(2000)) for _ in range(2))
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, other), (9, text[:500] + other[:150]), (None, other[:199])], "doc_id long, text string"))
    began = time.time()
    got = {(r.doc_id, r.n_removed, r.n_spans): r["count"] for r in suffix_dedup.dedup(docs, **limits).groupBy("doc_id", "n_removed", "n_spans").count().collect()}
    assert got == {(7, 2000, 1): 20_000, (8, 0, 0): 1, (9, 500, 1): 1, (None, 0, 0): 1}
    assert time.time() - began < 60


# ---- joins of many test items, and wide groups of texts that share a frame


@pytest.mark.parametrize("bits,fetched", [(29, 500), (10, 2)])
def test_decontamination_paths_agree(spark, monkeypatch, bits, fetched):
    """The join finds what the broadcast does, also with a bit table that is too small and documents fetched in turns."""
    monkeypatch.setattr(decontaminate, "TABLE_BITS", bits)
    monkeypatch.setattr(decontaminate, "FETCHED", fetched)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60)))) for i in range(150)] + [(None, "a b c d e f g h i j k l"), (7, None), (8, "common seed here " * 5)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice([x for _, x in items if x]).split()
            for _ in range(rng.randint(0, len(t) // 5)):
                t[rng.randrange(len(t))] = "zz"
            parts += [*rng.choices(words, k=rng.randint(0, 10)), *t]
        docs.append((i, " ".join(parts)))
    docs += [(None, items[3][1]), (5, docs[5][1]), (6, None)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    sent, joined = (sorted(map(str, decontaminate.contaminated(d, t, n).collect())) for n in (2_000_000, 0))
    assert sent == joined and len(sent) > 60
    kept, left = (sorted(str(r.text) for r in decontaminate.clean(d, t, n).collect()) for n in (2_000_000, 0))
    assert kept == left


def test_wide_groups_are_cut_by_prefixes(spark):
    """Very many texts under one key that share half their shingles: none meets all others, and the alike are found."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, frame = 20_000, rng.integers(0, 1 << 31, 40, dtype=np.uint32)
    sets = [np.unique(np.concatenate([frame, rng.integers(0, 1 << 31, 40, dtype=np.uint32)])) for _ in range(n)]
    twins = {(i, n + i): np.unique(np.concatenate([sets[i][3:], rng.integers(0, 1 << 31, 3, dtype=np.uint32)])) for i in range(50)}
    rows = [(i, s.tobytes(), len(s)) for i, s in enumerate(sets)] + [(b, s.tobytes(), len(s)) for (_, b), s in twins.items()]
    df = spark.createDataFrame(rows, "node long, shingles binary, size long").repartition(4)
    groups, roots = df.select(F.lit(1).cast("long").alias("key"), "node"), spark.createDataFrame([], "node long, root long")
    cut = simhash._by_prefix(groups, df.select("node", "shingles"), 0.8)
    sizes = cut.groupBy("key").count().where("count > 1").agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 100 and sizes[1] < 20 * n
    links = simhash._links_between(groups, roots, df.select("node", "size"), df.select("node", "shingles"), 0.8)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} == set(twins)


# ---- language machines against independent forms


def test_machines_reach_the_optimum():
    """Accelerated descent against Newton's method on the same objective."""
    import numpy as np

    from pressline.llm import language_id

    rng = np.random.default_rng(4)
    for n, m in ((60, 30), (200, 20), (30, 300)):
        x = rng.normal(size=(n + m, 12))
        x[:n] += 0.4
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.r_[np.ones(n), -np.ones(m)]
        each = np.where(y > 0, 0.5 / n, 0.5 / m)
        one = np.column_stack([x, np.ones(n + m)])
        objective = lambda w: (each * np.maximum(0, 1 - y * (one @ w)) ** 2).sum() + language_id.L2 / 2 * w @ w
        best = np.zeros(13)
        for _ in range(200):
            active = 1 - y * (one @ best) > 0
            a = one[active]
            new = np.linalg.solve(2 * (a * each[active, None]).T @ a + language_id.L2 * np.eye(13), 2 * a.T @ (each * y)[active])
            best = min((best + s * (new - best) for s in (1, 0.5, 0.25, 0.1, 0.01)), key=objective)
        w, offset = language_id.train_pair(x.astype(np.float32), y.astype(np.float32))
        assert objective(np.r_[w, offset]) <= 1.02 * objective(best) + 1e-4


def test_duels_counted_by_hand():
    import itertools

    from pressline.llm import language_id

    c = language_id.Classifier({"families": {}, "machines": {}})
    rng = random.Random(2)
    for size in (1, 2, 3, 5):
        for _ in range(50):
            names = [f"l{i}" for i in range(size)]
            margins = {("lang", a, b): rng.choice([-1.0, -0.25, 0.0, 0.25, 1.5]) for a, b in itertools.combinations(names, 2)}
            of = lambda a, b: margins["lang", a, b] if (("lang", a, b) in margins) else -margins["lang", b, a]
            table = []
            for a in names:
                won = sum(of(a, b) > 0 or (of(a, b) == 0 and a < b) for b in names if b != a)
                table.append((-won, -sum(of(a, b) for b in names if b != a), a))
            best = min(table)[2]
            got, confidence = c._choose("lang", names, margins)
            assert got == best and confidence == pytest.approx(min([1.0, *(1 / (1 + math.exp(-4 * of(best, b))) for b in names if b != best)]))


def test_a_machine_copies_no_vectors():
    import tracemalloc

    import numpy as np

    from pressline.llm import language_id

    x = np.random.default_rng(1).random((400, language_id.DIM), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(np.arange(400) % 2, 1, -1).astype(np.float32)
    tracemalloc.start()
    language_id.train_pair(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.2 * x.nbytes


def test_vectors_dealt_in_small_batches():
    import pyarrow as pa

    from pressline.llm import language_id

    rows = [("ab" if i < 600 else "c", i % 600 + 1, bytes([i % 251])) for i in range(1000)]
    wanted = {"ab": [(100, ("family", "a", "b", 1))] + [(600, ("lang", "ab", f"x{k}", 1)) for k in range(30)], "c": [(50, ("family", "a", "b", -1))], "x": []}
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "rank", "x"])
    dealt = list(language_id.deal(iter([batch, batch.slice(0, 0)]), wanted))
    assert max(b.num_rows for b in dealt) <= language_id.STEP
    expected = [(*duel, x) for lang, rank, x in rows for limit, duel in wanted[lang] if rank <= limit]
    assert sorted(tuple(r.values()) for b in dealt for r in b.to_pylist()) == sorted(expected)


def test_training_writes_no_file_for_each_partition(spark):
    """Each file of the checkpoint folder is a process started beside the executor."""
    import os

    from pressline.llm import language_id

    def files():
        top = spark.sparkContext.getCheckpointDir()
        return sum(len(names) for _, _, names in os.walk(top.removeprefix("file:"))) if top else 0

    words = {"en": "the house and the garden of this town", "de": "das haus und der garten dieser stadt", "fr": "la maison et le jardin de cette ville"}
    docs = spark.createDataFrame([(i, f"{words[lang]} {i}", lang) for i in range(60) for lang in [sorted(words)[i % 3]]], "doc_id long, text string, lang string")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    usual = {k: spark.conf.get(k) for k in held}
    before, kept = files(), spark.sparkContext._jsc.getPersistentRDDs().size()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        model = language_id.train(docs)
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert sorted(model["machines"]) == [("family", "germanic", "romance"), ("lang", "de", "en")]
    assert [language_id.Classifier(model).predict(t)[0] for t in words.values()] == list(words)
    assert files() - before < 10
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


# ---- the randomness battery against a slow form


def slow_randomness(token, alphabet):
    from itertools import groupby

    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    k, n = len(alphabet), len(token)
    values = [alphabet.index(c) for c in token]
    if len(set(values)) == 1:
        return 0.0
    chi = sum((values.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    ps = [tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    kind = lambda c: "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other"
    expected = {x: n * sum(kind(c) == x for c in alphabet) / k for x in {kind(c) for c in alphabet}}
    expected = {x: e for x, e in expected.items() if e / n > 0.05}
    chi, df = sum((sum(kind(c) == x for c in token) - e) ** 2 / e for x, e in expected.items()), len(expected) - 1
    # tails of the chi-squared distribution with one and two degrees of freedom
    ps.append(1.0 if df < 1 else math.exp(-chi / 2) if df == 2 else math.erfc(math.sqrt(chi / 2)))
    high = [v >= k / 2 for v in values]
    runs, n1 = len(list(groupby(high))), sum(high)
    n0 = n - n1
    if n0 and n1:
        mean = 2 * n1 * n0 / n + 1
        var = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
        ps.append(2 * tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    middle = (k - 1) / 2
    r = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / sum((v - middle) ** 2 for v in values)
    ps.append(2 * tail(abs(r) * math.sqrt(n)))
    h = -sum(math.log(min(1.0, max(p, 1e-300))) for p in ps)
    return min(1.0, math.exp(-h) * sum(h**i / math.factorial(i) for i in range(4)))


def test_randomness_against_a_slow_form():
    from pressline.llm import secret_scan

    rng = random.Random(6)
    for e, (name, alphabet) in enumerate(secret_scan.ENCODINGS):
        for _ in range(40):
            n = rng.randint(20, 90)
            few = alphabet if rng.random() < 0.5 else "".join(rng.sample(alphabet, rng.randint(1, min(6, len(alphabet)))))
            token = "".join(rng.choice(few) for _ in range(n)) if rng.random() < 0.8 else "".join(sorted(rng.choice(alphabet) for _ in range(n)))
            assert secret_scan.randomness(token, e) == pytest.approx(slow_randomness(token, alphabet), rel=1e-6, abs=1e-12), (name, token)
