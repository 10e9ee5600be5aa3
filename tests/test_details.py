"""Message details, rules and restarts on small cases that the tables do not hold."""

from pyspark.sql import functions as F

from pressline.functions import blocks as B
from pressline.functions import text as T
from pressline.operators import detail as D
from pressline.operators import events as E
from pressline.operators import ingest, search
from pressline.sources import files


def test_pending_raw(spark):
    raws = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, None)], "id long, supersedes long")
    items, runs = spark.createDataFrame([(3,)], "raw_item_id long"), spark.createDataFrame([(4,), (9,)], "raw_item_id long")
    assert [r.id for r in search.pending_raw(raws, items, runs).collect()] == [2]


def test_evidence_gate_on_short_texts(spark):
    df = spark.createDataFrame([("", "eleven char", False), ("", "eleven char", True), ("t", "twelve chars x", False), (None, None, False)], "t string, x string, p boolean")
    assert [r[0] for r in df.select(T.evidence_gate(F.col("t"), F.col("x"), F.col("p"))).collect()] == ["insufficient_evidence", "process", "process", "insufficient_evidence"]


def test_decisions(spark):
    row = lambda *x: x
    df = spark.createDataFrame(
        [row("merge", None, "tft", "a", False), row("attach", None, "tft", "a", False), row("create", 5, "tft", "a", False), row("attach", 6, "tft", "a", False), row("attach", 5, "lol", "a", False), row("attach", 5, "tft", "z", False), row("create", None, "tft", "a", True), row("ignore", None, None, None, True)],
        "action string, event long, product string, family string, repost boolean",
    )
    error = ingest.decision_error(F.col("action"), F.col("event"), F.array(F.lit(5)), F.col("product"), F.array(F.lit("tft")), F.col("family"), F.array(F.lit("a")), F.col("repost"))
    assert [r[0] for r in df.select(error).collect()] == [
        "unsupported action", "attach needs an event", "only attach names an event", "event is no candidate", "product is not the message's", "family is outside the space", "a repost creates no event", None,
    ]


def test_mentions_number_from_zero(spark):
    rows = [(1, 1, "v", 0), (1, 1, "v", 1), (2, 1, "v", 1), (3, 1, "v", 0), (3, 1, "v", 0), (4, 1, "v", 0), (4, 1, "v", 2)]
    got = {r.item_id: r.in_order for r in D.mention_groups_in_order(spark.createDataFrame(rows, "item_id long, item_revision long, policy string, mention_index long")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_late_evidence_never_wins(spark):
    events = spark.createDataFrame([(1, "own", "s"), (2, "own", "s"), (3, "own", "s")], "event_id long, title string, current_summary string")
    key = "event_id long, item_id long, item_revision long, mention_index long, policy string"
    mentions = spark.createDataFrame([(1, 1, 1, 0, "v", 10, 500, "material_update"), (1, 2, 1, 0, "v", 11, 400, "material_update"), (2, 3, 1, 0, "v", 12, 1, "duplicate")], key + ", id long, time_us long, materiality string")
    revisions = spark.createDataFrame([(1, 1, 1, 0, "v", ("early", "x", "denied")), (1, 2, 1, 0, "v", ("late revision", "y", None)), (1, 9, 1, 0, "v", ("gone", "z", None)), (2, 3, 1, 0, "v", ("no", "n", None))], key + ", snapshot struct<title:string,current_summary:string,lifecycle_status:string>")
    got = {r.event_id: tuple(r)[1:] for r in E.restored_projection(events, mentions, revisions).collect()}
    assert got == {1: ("early", "x", "denied"), 2: ("own", "s", "stale"), 3: ("own", "s", "stale")}


def test_preview_titles(spark):
    kind = "array<struct<section_type:string,label:string,records:array<struct<target:string,raw_changes:array<string>>>>>"
    rows = [(1, "\u00a0\n Patch 14.3 notes\nmore", [("champion_buff", None, [("A ", ["+1 ", " "])])]), (2, None, [("", "System: Nerfs!", [("B", None)])])]
    got = {r.id: r for r in D.preview_entries(spark.createDataFrame(rows, f"id long, title string, sections {kind}")).collect()}
    assert (got[1].patch, got[1].title, got[1].target, got[1].changes) == ("14.3", "Patch 14.3 notes", "A", ["+1"])
    assert (got[2].patch, got[2].title, got[2].section_type, got[2].changes) == (None, "Patch Preview", "system_nerf", [])


def test_public_media_path(spark):
    df = spark.createDataFrame([("/media/x/a.png",), ("/media/private/a",), ("/media\\private\\a",), ("/api/a",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(D.public_media_path(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_platform_identity(spark):
    urls = ["https://www.x.com/Name/status/1", "https://weibo.com/u/123?x=1", "http://weibo.com/456/abc", "https://x.com/", "https://example.com/a", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(D.platform_identity(F.col("u"))).collect()]
    assert got == [("x_twitter", "Name"), ("weibo", "123"), ("weibo", "456"), None, None, None]


def test_text_signs(spark):
    df = spark.createDataFrame([("RT @a_b: x",), (" rt  @A : y",), ("see\n转发自 @a",), ("RT later",)], "x string")
    assert [r[0] for r in df.select(T.repost_evidence(F.col("x"))).collect()] == [True, True, True, False]
    df = spark.createDataFrame([("http://h/A.PNG?x=.gif",), ("/b.jpeg",), ("c.webp#d",), ("d.txt",)], "x string")
    assert [r[0] for r in df.select(T.mime_of(F.col("x"))).collect()] == ["image/png", "image/jpeg", "image/webp", None]
    assert [r[0] for r in spark.range(0, 5).select(T.backoff_seconds(F.col("id"))).collect()] == [30, 30, 120, 600, 600]
    # a no-break space is no blank that collapses, as in the rules that these follow
    assert spark.range(1).select(T.clean_text(F.lit(" a&nbsp;&lt;b&gt; \t&amp;amp;\x00 c\n"))).first()[0] == "a\xa0<b> &amp; c"


def test_quoted_post(spark):
    df = spark.createDataFrame([([("embed", "quoted_post")],), ([("embed", "video"), ("image", "quoted_post")],), ([],)], "b array<struct<type:string,embed_kind:string>>")
    assert [r[0] for r in df.select(B.has_quoted_post(F.col("b"))).collect()] == [True, False, False]


def test_traces_at_any_depth(spark):
    deep = '{"a":' * 40 + '{"model": "m", "usage": {"total_tokens": 5}, "latency_ms": 10, "x": {"model": "inner"}}' + "}" * 40
    r = files.trace_totals(spark.createDataFrame([(1, deep), (2, '{"prompt_name": null, "usage": 3}'), (3, None), (4, "[1]")], "id int, snapshot string")).first()
    assert tuple(r) == (2, 5, 5.0)
