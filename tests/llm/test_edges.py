"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables
and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from pressline.llm import decontaminate, html_extract, language_id, lm_score, mixing, quality_rules, secret_scan, simhash, suffix_dedup, token_counts

LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [None, "", " \n\t ", "word", "Same text of a few words here.", "Same text of a few words here.", "é" * 300, LONG, LONG + "x", "a1 " * 400, "\x00 odd ퟿ chars"]
IDS = [1, 2, 3, 4, 5, 5, None, 8, 9, 10, 11]
#: Columns that bear names of the operators' own ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, component_id long, size long, spans string, d long, t int, label string"


def documents(spark, empty=False):
    rows = [] if empty else [(i, x, None if n % 4 == 0 else "en", None if n % 3 == 0 else f"s{n % 2}", None, 7, 7, 7, 7, "x", 7, 7, "x") for n, (i, x) in enumerate(zip(IDS, TEXTS))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def benchmark(spark):
    return spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum"), (2, None), (3, ""), (4, "word"), (4, "word")], "item_id long, text string")


PER_ROW = {
    "suffix": lambda s, d: suffix_dedup.dedup(d),
    "secrets": lambda s, d: secret_scan.find_secrets(d),
    "quality": lambda s, d: quality_rules.verdicts(quality_rules.ledger(d)),
    "lm": lambda s, d: lm_score.score_documents(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "mixing": lambda s, d: mixing.mix(d).select("document.doc_id"),
    "language": lambda s, d: language_id.identify(d, language_id.train(d)),
    "tokens": lambda s, d: token_counts.counts(d),
    "copies": lambda s, d: simhash.copy_groups(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_document(spark, name):
    out = PER_ROW[name](spark, documents(spark))
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(map(str, IDS))


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, documents(spark, empty=True)).count() == 0


def test_decontamination_edges(spark):
    hits = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(documents(spark), benchmark(spark)).collect()}
    assert hits == {(8, 1): 12, (9, 1): 12, (4, 4): 1}
    assert decontaminate.contaminated(documents(spark, True), benchmark(spark)).count() == 0
    assert decontaminate.contaminated(documents(spark), benchmark(spark).limit(0)).count() == 0
    for tokens in (2_000_000, 0):
        kept = decontaminate.clean(documents(spark), benchmark(spark), tokens)
        assert kept.count() == len(IDS) - 3 and kept.columns == documents(spark).columns


def test_clean_judges_rows(spark):
    """Rows that share an id, or have none, are judged by their own texts on both paths."""
    bad = "lorem ipsum dolor sit amet " * 4
    docs = spark.createDataFrame([(1, bad), (1, "fine"), (None, bad), (None, "good"), (None, None)], "doc_id long, text string")
    for tokens in (2_000_000, 0):
        assert sorted(str(r.text) for r in decontaminate.clean(docs, benchmark(spark), tokens).collect()) == ["None", "fine", "good"]


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "", "", 1), (3, "http://h/1", "plain", 1), (4, "http://h/2", "<p>" + "x " * 100000, 1), (4, "http://h/2", "<p>" + "x " * 100000, 1), (5, "nonsense", "<div", 1), (6, "http://h/3", "<<a b=<p>c", 1)], "page_id long, url string, html string, host int")
    got = sorted((r.page_id, r.n_chars) for r in html_extract.main_text(pages).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, 5, 6] and dict(got)[1] == 0 and dict(got)[3] == 5 and dict(got)[4] == 199999
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_filters_keep_columns(spark):
    d = documents(spark)
    for stage in (quality_rules.filter_documents, simhash.drop_copies, secret_scan.redact):
        out = stage(d)
        assert out.columns == d.columns
        out.collect()
        assert stage(documents(spark, True)).count() == 0
    assert simhash.drop_copies(d).where(F.col("doc_id") == 5).count() == 1
    assert simhash.drop_copies(d).where(F.col("doc_id").isin(8, 9)).count() == 1  # five of six shingles are shared


#: Names that the operators use inside, as further columns of the documents.
GOOD = "The house by the river was sold last year, and nobody in the village knows who will live there when the summer comes."
INNER = ["passes", "_quota", "quota", "_node", "node", "root", "_measured", "fail_mask", "copies", "_size", "_one", "_order", "order", "bucket", "edge", "_bucket", "_d", "_n", "_leak", "_row", "row", "kept", "document", "target", "source_size", "z"]


def test_clashing_names(spark):
    """Further columns that bear inner names are kept as they are, and do no harm."""
    good = spark.createDataFrame([(20, GOOD, "en", "s1")], "doc_id long, text string, lang string, source string")
    d = documents(spark).select(*good.columns).unionByName(good).select("*", *(F.lit(f"own {c}").alias(c) for c in INNER))
    own = [f"own {c}" for c in INNER]
    for stage in (quality_rules.filter_documents, simhash.drop_copies, secret_scan.redact, *(lambda x, n=n: decontaminate.clean(x, benchmark(spark), n) for n in (2_000_000, 0))):
        out = stage(d)
        rows = out.collect()
        assert out.columns == d.columns and rows and all(list(r[4:]) == own for r in rows)
    mixed = mixing.mix(d).collect()
    assert len(mixed) == len(IDS) + 1 and all(list(r.document[4:]) == own for r in mixed)
    for name in sorted(PER_ROW):
        assert PER_ROW[name](spark, d).count() == len(IDS) + 1


def test_pipeline_edges(spark, tmp_path):
    """The five stages on nulls, clashing names and an empty table."""
    import corpus_pipeline

    for empty in (False, True):
        folder = tmp_path / str(empty)
        good = spark.createDataFrame([(20 + i, GOOD + f" {i}" * i, "en", "s1", None) for i in range(0 if empty else 5)], "doc_id long, text string, lang string, source string, n_chars long")
        d = documents(spark, empty).select(*good.columns).unionByName(good).select("*", *(F.lit(1).alias(c) for c in INNER))
        d.write.parquet(str(folder / "documents.parquet"))
        benchmark(spark).write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert sorted(out.columns) == sorted(d.columns)
        assert bool(out.collect()) != empty
