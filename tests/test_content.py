"""Messages, reports, blocks, entities, sources and cursors on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pressline.functions import blocks as B
from pressline.functions import entities as N
from pressline.functions import text as T
from pressline.operators import daily, ingest, messages, ops, search
from pressline.sources import cursor, html_blocks, platforms
from pressline.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_report_is_greedy_and_event_disjoint(spark):
    items = spark.createDataFrame(
        [(i, "published", "original", s, 1_786_579_200_000_000 + i, ["lol_pc"]) for i, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.65), (5, 0.59))],
        "id long, status string, content_form string, importance_score double, published_us long, products array<string>",
    )
    mentions = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11)], "item_id long, event_id long")
    # 2 shares an event with 1 and is left out; it blocks nothing, so 3 stays
    assert [r.id for r in daily.daily_report(items, mentions).orderBy("position").collect()] == [1, 3, 4]


def test_civil_day_boundary(spark):
    day = lambda us: str(one(spark, search.civil_date(F.lit(us))))
    assert day(1_786_550_399_000_000) != day(1_786_550_400_000_000)  # 15:59:59Z and 16:00:00Z


def test_regeneration(spark):
    reports = spark.createDataFrame([("a", 100, 90, False), ("b", 100, 110, False), ("c", 100, 110, False), ("d", 100, 110, True)], "report_date string, scheduled_us long, written_us long, withdrawn boolean")
    updates = spark.createDataFrame([("b", 112), ("c", 500), ("d", 112)], "report_date string, updated_us long")
    assert {r[0] for r in daily.needs_regeneration(reports, updates, 15).collect()} == {"a", "b"}


@pytest.mark.parametrize("message_type,topics,content,profile", [
    ("game_notice", ["service_technical"], "Hotfix now", "patch_hotfix"), ("game_notice", ["security_fair_play"], "", "security_notice"), ("game_community_notice", ["shop_monetization"], "rare chroma", "shop_rare_cosmetic"),
    ("game_community_notice", ["activities_rewards"], "free epic skin", "activity_free_skin"), ("game_community_notice", ["activities_rewards"], "free skin 抽奖", "free_reward"), ("esports_announcement", ["esports_matches"], "Worlds finals", "worlds_key"),
    ("game_announcement", ["champions"], "周免英雄", "weekly_free_champion_rotation"), ("unknown", ["unknown"], "", "unknown"),
])
def test_profiles(spark, message_type, topics, content, profile):
    df = spark.createDataFrame([(message_type, topics, content)], "message_type string, topics array<string>, content string")
    assert messages.importance_profile(df).first().profile == profile


def test_scores_are_clamped(spark):
    df = spark.createDataFrame(
        [("esports_announcement", ["esports_matches"], "worlds final", "repost", "major", "lpl", "star", "none", True)],
        "message_type string, topics array<string>, content string, content_form string, scale string, competition_region string, prominence string, skin_tier string, is_bulk_update boolean",
    )
    r = messages.message_importance(df).first()
    assert (r.profile_score, r.importance) == (0.86, 0.78)


def test_text_functions(spark):
    assert one(spark, T.display_title(F.lit(" "), F.lit("A"), F.lit("\n  b  c\nd"))) == "A：b c"
    assert len(one(spark, T.display_title(F.lit("x" * 600), F.lit(None), F.lit(None)))) == 500
    assert one(spark, T.detect_language(F.lit("英雄 abc"))) == "zh-CN" and one(spark, T.detect_language(F.lit("  "))) == "unknown"
    assert one(spark, T.upstream_url(F.lit("http://X.com/a/?q=1#f"))) == "https://x.com/a" and one(spark, T.upstream_url(F.lit("ftp://x"))) is None
    assert one(spark, T.classification_url(F.lit("https://u:p@x.com/a"))) is None
    assert one(spark, T.strip_handle(F.lit("Name (@handle)"))) == "Name"


def test_blocks(spark):
    raw = [dict(type=" Video ", source_url="https://v/1"), dict(type="heading", text=" T ", level=9), dict(type="list", items=["a ", " "]), dict(type="paragraph", text="p\n")]
    rows = [tuple(b.get(c) for c in B.FIELDS) for b in raw]
    df = spark.createDataFrame([(rows,)], f"blocks array<{B.BLOCK}>")
    r = df.select(B.first_error(B.checked_blocks(F.col("blocks"))).alias("e"), B.normalize_blocks(F.col("blocks")).alias("n")).first()
    assert r.e is None and [(b.id, b.type) for b in r.n] == [("b0001", "embed"), ("b0002", "heading"), ("b0003", "list"), ("b0004", "paragraph")]
    assert r.n[0].embed_kind == "video" and r.n[1].level == 6
    n = df.select(B.normalize_blocks(F.col("blocks")).alias("b"))
    assert n.select(B.block_text(F.col("b"))).first()[0] == "T\n\na\n\np"
    bad = spark.createDataFrame([([tuple(dict(type="image").get(c) for c in B.FIELDS)],)], f"blocks array<{B.BLOCK}>")
    assert bad.select(B.first_error(B.checked_blocks(F.col("blocks")))).first()[0] == "source required"


def test_hash_ignores_local_copies(spark):
    b = lambda **kw: tuple({"type": "image", "source_url": "https://tiebapic.baidu.com/x?tb=1", **kw}.get(c) for c in B.FIELDS)
    df = spark.createDataFrame([([b()],), ([b(storage_path="/a")],), ([b(source_url="https://tiebapic.baidu.com/x?tb=2")],), ([b(source_url="https://other/x?tb=2")],)], f"blocks array<{B.BLOCK}>")
    h = [r[0] for r in df.select(B.content_hash(F.col("blocks"))).collect()]
    assert h[0] == h[1] == h[2] != h[3]


def test_entities(spark):
    e = [("club", "ＧＥＮ 战队", "CORE"), ("team", "gen", None), ("league", "2024 LPL Spring", "x"), ("player", "李 Faker", None), ("hero", " ", None)]
    df = spark.createDataFrame([(e,)], "e array<struct<type:string,name:string,role:string>>").select(N.normalize_entities(F.col("e")).alias("n"))
    assert [(x.type, x.canonical_id, x.role) for x in df.first().n] == [("team", "team:gen", "core"), ("league", "league:lpl", "context"), ("player", "player:faker", "context")]
    assert df.select(N.anchors(F.col("n")).alias("a")).first().a == {"team": ["team:gen"], "league": ["league:lpl"], "player": ["player:faker"]}


def test_revisions_compare_with_the_latest(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate("aabba")], "key long, arrival long, content_hash string")
    got = ingest.revisions(rows).orderBy("arrival").collect()
    assert [r.action for r in got] == ["create", "skip", "revise", "skip", "revise"] and [r.supersedes for r in got] == [None, None, 0, None, 2]


def test_cursor_fold_equals_steps(spark):
    steps = [(1, True, ["a"], 10), (2, True, ["b"], 30), (3, False, ["c"], 20), (4, True, ["d"], None)]
    c: dict = {}
    for _, truncated, ids, high in steps:
        c = cursor.next_cursor(c, ids, [high] if high else [], truncated)
    assert c == {"watermark": 30, "high": None, "pending": ["d"]}
    r = ingest.advance_cursor(spark.createDataFrame([(1, *s) for s in steps], "source int, batch int, truncated boolean, ids array<string>, high_us long")).first()
    assert (r.watermark_us, r.pending_high_us, r.pending_ids) == (30, None, "d")
    rng = random.Random(3)
    steps = [(s, n, rng.random() < 0.7, [f"{s}-{n}", "same"], rng.choice([None, rng.randrange(99)]), [f"skip{n}"] if rng.random() < 0.3 else None) for s in range(20) for n in range(rng.randint(1, 9))]
    folded: dict = {}
    for s, _, truncated, ids, high, skipped in steps:
        folded[s] = cursor.next_cursor(folded.get(s, {}), ids, [high] if high is not None else [], truncated, skipped or [])
    got = ingest.advance_cursor(spark.createDataFrame(steps, "source int, batch int, truncated boolean, ids array<string>, high_us long, skipped array<string>")).collect()
    assert {r.source: (r.watermark_us, r.pending_high_us, r.pending_ids) for r in got} == {s: (c["watermark"], c["high"], ",".join(c["pending"])) for s, c in folded.items()}
    assert cursor.since({"watermark": 100_000_000}, None, 1) == 40_000_000


def test_replay_source(spark, tmp_path):
    for n, truncated in enumerate((True, False)):
        cursor.Recording(str(tmp_path)).add(n, [{"id": f"{n}-{i}", "published_us": n * 10 + i} for i in range(3)], truncated)
    cursor.register(spark)
    got = jobs.run_available(spark.readStream.format("replay").option("path", str(tmp_path)).load())
    assert sorted(r.external_id for r in got.collect()) == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2"]


def test_membership_match(spark):
    row = lambda a, k, f=None, r=None: (a, k, f, r)
    kind = "array<struct<action:string,event_key:string,event_family:string,relation:string>>"
    df = spark.createDataFrame([
        ([row("attach", "1"), row("attach", "1", None, "denies")], [row("attach", "1", "x", "denies"), row("attach", "1", "x", "reports")]),
        ([row("attach", "1", None, "denies"), row("attach", "1")], [row("attach", "1", "x", "denies"), row("attach", "1", "x", "reports"), row("create", "2", "x", "reports")]),
        ([], []),
    ], f"e {kind}, p {kind}")
    got = [tuple(r.o) for r in df.select(ops.membership_outcome(F.col("e"), F.col("p")).alias("o")).collect()]
    assert got == [(1, 1), (0, 1), (0, 0)]  # greedy: a wildcard may take the wrong one


def test_html_blocks():
    got = html_blocks.page_blocks("<h2>T &amp; x</h2><p>a <b>b</b><p>c<ul><li>1<li>2</ul><img data-src='/i.png'><blockquote><p>q</p></blockquote><script>p</script>", "https://h/d/")
    assert [(b["type"], b.get("text") or b.get("items") or b["source_url"]) for b in got] == [("heading", "T & x"), ("paragraph", "a b"), ("paragraph", "c"), ("list", ["1", "2"]), ("image", "https://h/i.png"), ("quote", "q")]
    assert html_blocks.page_blocks(None, None) == []


def test_platform_records(spark):
    tweet = {"id_str": "1", "url": "u", "date": "2024-01-02 03:04:05", "rawContent": "see https://t.co/a https://t.co/b", "user": {"username": "n"}, "media": {"photos": [{"url": "p"}]}, "links": [{"url": "https://x.y/z", "tcourl": "https://t.co/a"}], "quotedTweet": {"url": "q"}}
    df = spark.createDataFrame([(json.dumps(tweet),), ("{broken",)], "value string")
    a, b = platforms.tweets(df).collect()
    assert [(x.type, x.text or x.source_url) for x in a.blocks] == [("paragraph", "see x.y"), ("image", "p"), ("embed", "引用推文"), ("embed", "外部链接")] and not a.rejected and b.rejected
    post = {"mid": "9", "mblogid": "M", "created_at": "Tue Jan 02 03:04:05 +0800 2024", "text_raw": " t ", "user": {"id": 5, "screen_name": "s"}, "pic_ids": ["k"]}
    w = platforms.weibo_posts(spark.createDataFrame([(json.dumps(post),)], "value string")).first()
    assert w.url == "https://weibo.com/5/M" and str(w.published_at) == "2024-01-01 19:04:05" and len(w.blocks) == 2


def test_outbox(spark):
    rows = spark.createDataFrame([(2, "k"), (1, "k"), (3, "old"), (4, "n")], "id long, dedupe_key string")
    got = ingest.insert_new(spark.createDataFrame([("old",)], "dedupe_key string"), rows)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "k"), (4, "n")]


def test_search_parameters(spark):
    items = spark.createDataFrame([(1, "published", ["tft"], ["unknown"], "unknown", 0.9, 0.1, "original", "A%b", "x", "y", 5)], "id long, status string, products array<string>, topics array<string>, message_type string, importance_score double, priority_score double, content_form string, title string, content string, author string, seen_us long")
    page, total = search.search_published(items, query="a%", featured=True)
    assert page.count() == 1 and total.first().total == 1
    with pytest.raises(ValueError):
        search.search_published(items, sort_by="nope")
    with pytest.raises(ValueError):
        search.search_published(items, limit=101)


def test_visual_rows_against_loop(spark):
    import random

    from pressline.operators import layout

    rng = random.Random(3)
    lines = [(1 + i % 2, i, f"t{i}", rng.randint(0, 300), y := rng.randint(0, 60), 0, y + 10, 1000, 1400) for i in range(60)]
    df = spark.createDataFrame(lines, "image_id int, line int, text string, x0 int, y0 int, x1 int, y1 int, width int, height int")
    got = {(r.image_id, r.row): r.text for r in layout.visual_rows(df, ["image_id"]).collect()}
    for image in (1, 2):
        rows = []
        for cy, x, t in sorted(((r[4] + r[6]) / 2, float(r[3]), r[2]) for r in lines if r[0] == image):
            if rows and abs(cy - sum(c for c, _, _ in rows[-1]) / len(rows[-1])) <= 5.6:
                rows[-1].append((cy, x, t))
            else:
                rows.append([(cy, x, t)])
        want = {(image, i): "  ".join(t for _, t in sorted((x, t) for _, x, t in r)) for i, r in enumerate(rows)}
        assert {k: v for k, v in got.items() if k[0] == image} == want


def test_packing(spark):
    from pressline.functions import packing

    texts = ["a" * 10, "b" * 20, "c" * 500, "d", "e"]
    got = one(spark, packing.chunk_numbers(F.array(*map(F.lit, texts)), 2, 300))
    assert got == [0, 0, 1, 2, 2]
    picked = one(spark, packing.pick_within(F.array(*map(F.lit, ["none here", "has Term", "x" * 30])), F.array(F.lit("term")), 20))
    assert picked == "none here\nhas Term\nx"[:20]


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    from pressline.sources import files

    (tmp_path / "a.jsonl").write_text('{"case_id":"1","task":"event","dataset_version":"v","expected":"x"}\n{broken\n{"case_id":"2"}\n{"case_id":"3","task":"nope","dataset_version":"v","expected":"x"}\n')
    valid, rejected = files.read_cases(spark, str(tmp_path / "a.jsonl"))
    assert [r.case_id for r in valid.collect()] == ["1"] and sorted(r.reason for r in rejected.collect()) == ["invalid JSON", "missing key", "unsupported task"]
    path = str(tmp_path / "report")
    files.overwrite_days(spark.createDataFrame([("d1", 1), ("d2", 2)], "report_date string, id int"), path)
    files.overwrite_days(spark.createDataFrame([("d2", 3)], "report_date string, id int"), path)
    assert sorted((str(r.report_date), r.id) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 3)]
    a, b = T.StructType.fromDDL("x int, s struct<a:int,b:int>"), T.StructType.fromDDL("x long, s struct<a:int>, y int")
    assert files.schema_difference(a, b) == ["- s.b", "~ x: int / bigint", "+ y"]
    assert files.markdown_table(spark.createDataFrame([(1, "a|b")], "i int, t string")).endswith("| 1 | a\\|b |")


def test_trace_totals(spark):
    from pressline.sources import files

    rows = [(1, '{"a": {"model": "m", "usage": {"total_tokens": 5}, "latency_ms": 10, "inner": {"model": "n"}}, "b": {"c": {"prompt_name": "p", "latency_ms": 30}}}'), (2, '{"x": [1, 2], "y": "text"}')]
    r = files.trace_totals(spark.createDataFrame(rows, "id int, snapshot string")).first()
    assert (r.calls, r.tokens, r.latency_ms) == (2, 5, 20.0)
