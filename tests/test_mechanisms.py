"""Replays over restarts, counters, closing days, cascades, merges, kept stages, key pages,
table cells and case folding, on fixtures and against slow forms."""

import json
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressline.functions import entities as N
from pressline.functions import text as T
from pressline.operators import closure, layout, pages, stages
from pressline.sources import cursor
from pressline.streaming import counters, jobs, reports

MINUTE = 60_000_000


# ---- replayed source


def test_recordings(tmp_path):
    r = cursor.Recording(str(tmp_path / "deep" / "er"))
    records = [{"id": i, "published_us": i * 10, "text": "é\n" * 9000} for i in range(5)]
    r.add(3, records, True)
    assert r.has(3) and not r.has(4) and r.header(3) == {"truncated": True, "newest_us": 40} and list(r.records(3)) == records


def test_replay_over_two_restarts(spark, tmp_path):
    """Each record once, in triggers of at most two batches, whatever the restarts; what the
    overlap repeats is for the sink to drop, what lies below it is not read."""
    recording, out, state = cursor.Recording(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")
    cursor.register(spark)
    rng = random.Random(3)
    now, expected, n = 0, set(), 0

    def record(batches):
        nonlocal now, n
        for _ in range(batches):
            new = [{"id": f"{n}-{i}", "published_us": now + i * MINUTE} for i in range(3)]
            old = [{"id": f"{n - 1}-2", "published_us": now - MINUTE}] if n else []
            stale = [{"id": f"stale-{n}", "published_us": now - 600 * MINUTE}] if n > 3 else []
            recording.add(n, [*old, *new, *stale], truncated=n in (1, 2))
            expected.update(x["id"] for x in new)
            now += 3 * MINUTE
            n += 1

    sizes = []
    for batches in (5, 0, 4, 3):
        record(batches)
        # a new query each time: the offset comes from its log, the position from its progress
        rows = spark.readStream.format("replay").option("path", str(tmp_path / "in")).option("overlapMinutes", 5).option("batchesPerTrigger", 2).option("progress", str(tmp_path / "progress")).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        sizes += [p.sources[0].numInputRows for p in q.recentProgress if p.sources[0].numInputRows]
        if q.lastProgress is not None:  # none where nothing is new
            end = json.loads(q.lastProgress.json)["sources"][0]["endOffset"]
        q.stop()
    got = spark.read.parquet(out)
    ids = [r.external_id for r in got.collect()]
    assert set(ids) == expected and all(ids.count(f"{k}-{i}") == 1 + (i == 2 and k + 1 < n) for k in range(n) for i in range(3))
    assert {r[0] for r in got.dropDuplicates(["external_id"]).select("external_id").collect()} == expected
    assert max(sizes) <= 8 and len(sizes) >= 6
    end = json.loads(end) if isinstance(end, str) else end
    assert end == {"batch": n, "watermark": now - MINUTE, "high": None}


def test_truncated_batches_hold_the_watermark(tmp_path):
    recording = cursor.Recording(str(tmp_path))
    for n, (truncated, at) in enumerate([(False, 100), (True, 500), (True, 300), (False, 400), (False, 50)]):
        recording.add(n, [{"id": n, "published_us": at * MINUTE}], truncated)
    reader = cursor.ReplayReader(str(tmp_path), 10, 16, None)
    end = reader.latestOffset()
    assert end == {"batch": 5, "watermark": 500 * MINUTE, "high": None}
    assert [p.since_us for p in reader.partitions(reader.initialOffset(), end)] == [None, 90 * MINUTE, 90 * MINUTE, 90 * MINUTE, 490 * MINUTE]


# ---- counters


def test_counters_of_two_runs(spark, tmp_path):
    def start():
        rows = spark.readStream.schema("key long, arrival long, content_hash string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        made = counters.observed_revisions(jobs.ingested(counters.observed_arrivals(rows)))
        return made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    def add(rows):
        spark.createDataFrame(rows, "key long, arrival long, content_hash string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    add([(1, 1, "a"), (1, 2, "a"), (2, 3, "x")])
    add([(1, 4, "b"), (3, 5, "y")])
    assert counters.counted_run(spark, start) == {"discovered": 5, "created": 3, "revised": 1, "skipped": 1, "status": "completed", "error": None}
    add([(1, 6, "b"), (3, 7, "z"), (4, 8, "q")])
    assert counters.counted_run(spark, start) == {"discovered": 3, "created": 1, "revised": 1, "skipped": 1, "status": "completed", "error": None}


def test_counters_of_a_failing_run(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    out = counters.counted_run(spark, lambda: rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert out["status"] == "failed" and out["discovered"] == 0 and out["error"]


# ---- closing days


def test_days_close_reopen_and_close(spark, tmp_path):
    due = 1_704_067_200_000_000 - 8 * 3_600_000_000  # 2023-12-31 is due as the first of January begins in Shanghai
    minute = lambda m: due + m * MINUTE
    schema = "report_date string, us long"
    batches = [[("2023-12-31", minute(-100)), ("2023-12-31", minute(-1)), ("2024-01-01", minute(-50))], [("2023-12-31", minute(10)), ("2024-01-01", minute(12))], [("2024-01-01", minute(90))], [("2023-12-31", minute(14)), ("2024-01-02", minute(1500))], [("2024-01-03", minute(6000))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in")).select("report_date", F.timestamp_micros("us").alias("ts"))
    with reports.with_rocks(spark):
        got = sorted(tuple(r) for r in jobs.run_available(reports.closing_stream(stream, "1 minute")).collect())
    # the update of minute 14 comes when the day is over for good
    assert got == [("2023-12-31", "closed", due, 2), ("2023-12-31", "regenerated", due + 15 * MINUTE, 3), ("2024-01-01", "closed", due + 1440 * MINUTE, 3), ("2024-01-02", "closed", due + 2880 * MINUTE, 1), ("2024-01-03", "closed", due + 4320 * MINUTE, 0)]
    table = spark.createDataFrame([r for b in batches for r in b if r != ("2023-12-31", minute(14))], schema).select("report_date", F.timestamp_micros("us").alias("ts"))
    assert sorted(tuple(r) for r in reports.closing_table(table, MINUTE).collect()) == got


# ---- cascades and merges


def test_cascade_over_random_graphs(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = {"a": 12, "b": 20, "c": 15}
        references = [("b", "a_id", "a"), ("c", "b_id", "b"), ("a", "c_id", "c"), ("b", "b_id", "b"), ("c", "a_id", "a")]
        rows = {t: [{"id": i, **{c: rng.choice([None, rng.randrange(sizes[p])]) for ch, c, p in references if ch == t}} for i in range(n)] for t, n in sizes.items()}
        frames = {t: spark.createDataFrame([(r["id"], *(r[c] for ch, c, _ in references if ch == t)) for r in rs], "id long, " + ", ".join(f"{c} long" for ch, c, _ in references if ch == t)) for t, rs in rows.items()}
        gone = {("a", 1), ("c", 2)}
        while True:
            more = {(ch, r["id"]) for ch, c, p in references for r in rows[ch] if r[c] is not None and (p, r[c]) in gone} - gone
            if not more:
                break
            gone |= more
        ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
        left, found = closure.delete_cascading(frames, references, {"a": ids(1, 1, 999), "c": ids(2)})
        assert sorted((r.table, r.id) for r in found.collect()) == sorted(gone)
        for t, df in left.items():
            assert {r.id for r in df.collect()} == {r["id"] for r in rows[t]} - {i for k, i in gone if k == t}
    with pytest.raises(ValueError):
        closure.cascade(frames, [("b", "a_id", "nowhere")], {})


def test_update_from_against_another_engine(spark):
    import duckdb

    rng = random.Random(2)
    target = [(i, f"n{i}", rng.choice([None, 1.5, 2.5]), i % 3) for i in range(40)]
    source = [(rng.randrange(60), rng.randrange(5), rng.choice(["x", "y", None])) for _ in range(120)]
    t, s = spark.createDataFrame(target, "id long, name string, v double, g int"), spark.createDataFrame(source, "id long, at int, said string")
    got = sorted(map(tuple, closure.update_from(t, s, ["id"], {"name": F.coalesce("s.said", "t.name"), "v": F.col("t.v") + F.col("s.at")}, [F.desc("at")], F.col("t.g") > 0).collect()), key=str)
    c = duckdb.connect()
    c.sql("create table t (id bigint, name varchar, v double, g int)")
    c.sql("create table s (id bigint, at_ int, said varchar)")
    c.executemany("insert into t values (?, ?, ?, ?)", target)
    c.executemany("insert into s values (?, ?, ?)", source)
    c.sql("update t set name = coalesce(w.said, t.name), v = t.v + w.at_ from (select * from s qualify row_number() over (partition by id order by at_ desc, said nulls first) = 1) w where w.id = t.id and t.g > 0")
    assert got == sorted(c.sql("select * from t").fetchall(), key=str)
    added = closure.update_from(t, s, ["id"], {"name": F.lit("new")}, [F.desc("at")], insert=True)
    assert added.columns == t.columns and added.count() == 40 + len({k for k, _, _ in source if k >= 40}) and added.where("id >= 40 and v is null and name = 'new'").count() == len({k for k, _, _ in source if k >= 40})


# ---- kept stages


def test_only_what_changed_is_computed(spark):
    seen = {}

    def stage(name, expression):
        def compute(rows):
            seen[name] = sorted(r.id for r in rows.collect())
            return rows.select("id", expression.alias("output"))

        return compute

    graph = lambda version="1": [
        stages.Stage("last", ("c",), ("mid", "side"), stage("last", F.concat_ws("|", "mid", "side", "c"))), stages.Stage("mid", (), ("first",), stage("mid", F.lower("first")), version),
        stages.Stage("first", ("a",), (), stage("first", F.when(F.col("a") != "", F.upper("a")))), stages.Stage("side", ("b",), ("first",), stage("side", F.col("b").cast("string"))),
    ]
    schema = "id long, a string, b int, c string"
    before = [(1, "x", 1, "c"), (2, "y", 2, None), (3, "", 3, "c"), (4, "w", 4, "c")]
    kept = stages.run_stages(spark.createDataFrame(before, schema), graph())
    assert seen == {"first": [1, 2, 3, 4], "mid": [1, 2, 4], "side": [1, 2, 4], "last": [1, 2, 4]}
    # 1: another case, the same output of the first stage; 2: a later field; 3: comes alive; 4: goes
    after = spark.createDataFrame([(1, "X", 1, "c"), (2, "y", 2, ""), (3, "z", 3, "c")], schema)
    out = stages.run_stages(after, graph(), kept)
    assert seen == {"first": [1, 3], "mid": [3], "side": [3], "last": [2, 3]}
    assert {(r.id, r.output) for r in out["last"].collect()} == {(1, "x|1|c"), (2, "y|2|"), (3, "z|3|c")}
    assert {tuple(r) for r in stages.recomputed(out).collect()} == {("first", 2, 1), ("mid", 1, 2), ("side", 1, 2), ("last", 2, 1)}
    stages.run_stages(after, graph("2"), out)
    assert seen == {"first": [], "mid": [1, 2, 3], "side": [], "last": []}
    with pytest.raises(ValueError):
        stages.in_order([stages.Stage("p", (), ("q",), None), stages.Stage("q", (), ("p",), None)])


# ---- pages


@pytest.mark.parametrize("descending,nulls_first", [(False, False), (False, True), (True, False), (True, True)])
def test_pages_walked_to_the_end_equal_the_whole(spark, descending, nulls_first):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0.1, 0.2, 1 / 3]), rng.choice([None, "a", "b"])) for i in range(45)]
    df = spark.createDataFrame(rows, "id long, score double, name string").repartition(3)
    keys = [pages.Key("score", descending, nulls_first), pages.Key("name", not descending, nulls_first), pages.Key("id")]
    whole = [r.id for r in df.orderBy(*(k.order() for k in keys)).collect()]
    for limit in (20, 45):
        got = list(pages.walk(df, keys, limit))
        assert [r.id for p in got for r in p] == whole and [len(p) for p in got] == ([20, 20, 5] if limit == 20 else [45]) and [p[-1].has_more for p in got] == [True] * (len(got) - 1) + [False]
    assert list(pages.walk(df.limit(0), keys, 5)) == []
    for limit in (0, 51):
        with pytest.raises(ValueError):
            pages.page(df, keys, limit, most=pages.TOOL_LIMIT)


# ---- cells


def slow_cells(lines, ys, divider, width, height, full):
    kind = lambda t: next((f"{s.lower()}_{n}" for s in layout.SUBJECTS for c, n in layout.CHANGES.items() if s in t.upper() and c in t.upper()), None)
    heads = sorted(((y0 + y1) / 2, k, t) for k, (t, x0, y0, x1, y1, c) in enumerate(lines) if kind(t))
    plain = [x for x in lines if not kind(x[0])]
    out = []
    for a, b in zip(ys, ys[1:]):
        above = [h for h in heads if h[0] < (a + b) / 2]
        if b - a < max(7, round(height * 0.008)) or not above:
            continue
        inside = [x for x in plain if a <= (x[2] + x[4]) / 2 < b]
        edge = divider - max(4, round(width * 0.008)) if divider is not None else float("inf")
        left, right = [x for x in inside if x[1] < edge], [x for x in inside if x[1] >= edge]
        target = " ".join(x[0].strip() for x in sorted(left, key=lambda x: (x[2], x[1])) if x[0].strip())
        groups = []
        for x in sorted(right, key=lambda x: ((x[2] + x[4]) / 2, x[1])):
            at = (x[2] + x[4]) / 2
            if groups and abs(at - statistics.fmean((g[2] + g[4]) / 2 for g in groups[-1])) <= max(4.0, height * 0.004):
                groups[-1].append(x)
            else:
                groups.append([x])
        changes = ["  ".join(x[0].strip() for x in sorted(g, key=lambda x: x[1]) if x[0].strip()) for g in groups] if full else []
        sure = [x[5] for x in inside if x[5] is not None]
        if target:
            out.append((a, b, kind(above[-1][2]), above[-1][2], target, changes, round(sum(sure) / len(sure) if sure else 0.0, 9)))
    return out


@pytest.mark.parametrize("full", [True, False])
def test_cells_against_a_slow_form(spark, full):
    rng = random.Random(7)
    images = {}
    for n in range(12):
        lines = [(rng.choice(["Champion Buffs", "SYSTEM NERF", *["Ahri", " ", "Q damage", "+5", "longer text here"] * 3]), x := rng.choice([30, 40, 300, 310, 420]), y := rng.randrange(0, 900), x + 90, y + rng.choice([10, 11, 14]), rng.choice([None, 0.5, 0.9])) for _ in range(30)]
        lines = list({(y, x): (t, x, y, a, b, c) for t, x, y, a, b, c in lines}.values())
        ys = sorted({0, *rng.sample(range(900), 12), 899})
        images[n] = (lines, ys, rng.choice([None, 300]))
    schema = "image_id long, line int, text string, x0 int, y0 int, x1 int, y1 int, confidence double, width int, height int"
    lines = spark.createDataFrame([(n, k, *x, 1000, 900) for n, (ls, _, _) in images.items() for k, x in enumerate(ls)], schema)
    edges = spark.createDataFrame([(n, y) for n, (_, ys, _) in images.items() for y in ys], "image_id long, y int")
    dividers = spark.createDataFrame([(n, d, 0.5) for n, (_, _, d) in images.items()], "image_id long, divider_x int, support double")
    # lines by the side of a heading are decorations, which the slow form leaves in
    deco = {(r.image_id, r.line) for r in layout.decorations(lines).collect()}
    got = {}
    for r in layout.cells(lines, edges, dividers, full).orderBy("image_id", "y0").collect():
        got.setdefault(r.image_id, []).append((r.y0, r.y1, r.section_type, r.section_label, r.target, r.raw_changes, round(r.confidence, 9)))
    for n, (ls, ys, d) in images.items():
        assert got.get(n, []) == slow_cells([x for k, x in enumerate(ls) if (n, k) not in deco], ys, d, 1000, 900, full)
    sure = {r.image_id: r for r in layout.structure_confidence(layout.cells(lines, edges, dividers, full), edges, dividers, full).collect()}
    assert all(sure[n].records == len(got.get(n, [])) and 0 <= sure[n].confidence <= (1 if images[n][2] or not full else 0.35) for n in images)


def test_decorations(spark):
    rows = [(1, 0, "CHAMPION BUFFS", 100, 50, 300, 70), (1, 1, "◆", 70, 52, 90, 68), (1, 2, "long text", 20, 52, 90, 68), (1, 3, "◆", 70, 152, 90, 168), (1, 4, "◆", 310, 52, 330, 68), (1, 5, "ab", 0, 52, 60, 68), (2, 1, "◆", 70, 52, 90, 68)]
    lines = spark.createDataFrame(rows, "image_id long, line int, text string, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in layout.decorations(lines).collect()] == [(1, 1)]


# ---- names


def test_character_references_against_the_standard_library(spark):
    import html
    from html.entities import html5

    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**12, 10**30]
    said = [f"&{n}" for n in html5] + [f"a&{n}b" for n in html5] + [f"x&#{n};&#x{n:x}y&#X0{n:X};" for n in numbers] + ["&", "&&amp;", "&;", "&#;", "&#x;", "a & b", "&notit;", "&ampamp;", "&nosuch;", "&AMP", "no", "&#12a;", "", "&amp;lt;", "é&eacute;&#233"]
    got = {r.x: r.u for r in spark.createDataFrame([(x,) for x in said], "x string").select("x", T.unescaped(F.col("x")).alias("u")).collect()}
    wrong = {x: (u, html.unescape(x)) for x, u in got.items() if u != html.unescape(x)}
    assert not wrong, list(wrong.items())[:10]
    short = {f"a &{n}; &{n} b": html.unescape(f"a &{n}; &{n} b") for n in T.COMMON} | {"&#233;&#x4e2d;\x00\t x &amp;lt; &nosuch; ": "é中 x &lt; &nosuch;"}
    got = {r.x: r.u for r in spark.createDataFrame([(x,) for x in short], "x string").select("x", T.clean_text(F.col("x")).alias("u")).collect()}
    assert got == {x: " ".join(u.split(" ")).strip() for x, u in short.items()}


def test_names_compare_by_compatible_and_folded_forms(spark):
    names = ["Straße", "ﬁnal", "ｶﾞｽﾄ", "Ｔ１", "ΣΑΣ", "İstanbul", "Ⅷ", "é", "ŉ", None, "plain", "ΐ"]
    df = spark.createDataFrame([(names,), (["Abc", None],), ([],), (None,)], "names array<string>")
    got = [r.n for r in df.select(T.compatible(F.col("names")).alias("n")).collect()]
    assert got == [[None if x is None else unicodedata.normalize("NFKC", x) for x in names], ["Abc", None], [], None]
    said = [chr(c) for c in range(0xC0, 0x2500) if chr(c).isalpha()] + ["Straße ẞ", "ΑΣ ΑΣΣ", "Ǆ"]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", T.casefold(F.col("x")).alias("f")).collect()
    wrong = {r.x: r.f for r in rows if r.f != r.x.casefold()}
    assert not wrong or set(wrong) <= {c for c in said if len(c.lower()) != 1 or unicodedata.name(c[0], "").startswith("CHEROKEE")}, wrong
    same = [[("team", a, "core"), ("team", b, "core")] for a, b in (("Straße", "STRASSE"), ("ﬁnal", "Final"), ("ｶﾞｽﾄ", "ガスト"), ("Ｔ１", "t1"))]
    df = spark.createDataFrame([(x,) for x in same], "e array<struct<type:string,name:string,role:string>>")
    assert [len(r.n) for r in N.compatible_entities(df, "e").select(N.normalize_entities(F.col("e")).alias("n")).collect()] == [1, 1, 1, 1]


# ---- bulk collection


def test_bulk_collection_goes_on_where_it_stopped(spark, tmp_path):
    from pressline.streaming.collect import Collection

    recording = cursor.Recording(str(tmp_path / "in"))
    us = 1_700_000_000_000_000
    for n in range(6):
        new = {"id": f"m{n}", "external_id": f"m{n}", "title": f"t{n}", "content": f"text {n}", "published_us": us + n * MINUTE, "published_at": f"2024-01-01T00:0{n}:00Z"}
        again = {"id": f"m{n - 1}", "external_id": f"m{n - 1}", "title": f"t{n - 1} new", "content": "again", "published_us": us + (n - 1) * MINUTE} if n else {"id": "bad", "published_us": us}
        recording.add(n, [new, again])
    c = Collection("manual", 7, str(tmp_path / "in"), str(tmp_path / "out"), overlap_minutes=5, batches_per_trigger=2)
    first = c.run(spark, most_triggers=1).collect()
    assert 0 < sum(r.discovered for r in first) < 12
    summary = c.run(spark).collect()
    assert sum(r.discovered for r in summary) == 12 and sum(r.accepted for r in summary) == 11 and sum(r.rejected for r in summary) == 1
    got = {r.external_id: r.native_title for r in c.candidates(spark).collect()}
    assert set(got) == {f"m{n}" for n in range(6)} and got["m5"] == "t5" and got["m1"] == "t1 new"  # batches 1 and 2 come in different triggers
    assert [r.error for r in c.rejects(spark).collect()] == ["no content blocks"]
    assert sum(r.discovered for r in c.run(spark).collect()) == 12
