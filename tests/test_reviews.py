"""Connectors, platform records, greedy choices, labels, alerts and reports on fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pressline.operators import daily, lists, ops, reviews
from pressline.sources import connectors, files, platforms

TWEET = {
    "id_str": "7", "url": "", "date": "2024-01-02T03:04:05Z", "lang": "en", "user": {"username": "name", "displayname": " Name "}, "extra": 1,
    "rawContent": "see https://t.co/a now\nand https://t.co/b \n\n\n\nhttps://t.co/c https://t.co/zz", "media": {"photos": [], "videos": [], "animated": []}, "hashtags": ["x"],
    "links": [{"url": "https://youtu.be/1", "tcourl": "https://t.co/a", "text": "clip $1"}, {"expandedUrl": "https://site.example.org/x", "tcoUrl": "https://t.co/b"}, {"url": "https://other.example.org/", "tco_url": "https://t.co/c", "display_url": "shown"}, {"url": "", "tcourl": "https://t.co/d"}],
}


def mapped(spark, function, *records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "n int, value string")
    return [r for r in function(df).orderBy("n").collect()]


def short(blocks):
    return [(b.type, b.text, b.source_url, b.embed_kind) for b in blocks]


def test_tweets(spark):
    photo = {**TWEET, "id_str": "", "id": 8, "url": "https://x.com/o/status/8", "rawContent": "https://t.co/zz", "media": {"photos": [{"url": "https://p/x.PNG", "alt": " a "}, {"url": ""}], "videos": [{}], "animated": [1]}, "quotedTweet": {"url": "https://x.com/q/status/1", "id": 1}}
    again = {"id_str": "9", "rawContent": "RT https://t.co/a", "user": {"username": "n"}, "retweetedTweet": {"id": 3, "url": "https://x.com/r/status/3", "links": [{"url": "https://l.example.org", "tcourl": "https://t.co/a"}], "media": {"photos": [{"url": "https://p/r.jpg"}]}}}
    a, b, c, d, e = mapped(spark, platforms.tweets, TWEET, photo, again, "{broken", {"id_str": "5", "rawContent": " "})
    assert short(a.blocks) == [
        ("paragraph", "see clip $1 now\nand\n\nshown", None, None), ("embed", "外部视频", "https://youtu.be/1", "video"), ("embed", "外部链接", "https://site.example.org/x", "external_link"), ("embed", "外部链接", "https://other.example.org/", "external_link"), ("embed", "外部链接", "https://t.co/zz", "external_link"),
    ]
    assert (a.external_id, a.url, a.author, a.lang) == ("7", "https://x.com/name/status/7", "Name", "en") and str(a.published_at) == "2024-01-02 03:04:05" and not a.rejected
    kept = json.loads(a.response)
    assert "extra" not in kept and "user" not in kept and kept["media"] == {"photos": []} and kept["hashtags"] == ["x"]
    assert short(b.blocks) == [("image", None, "https://p/x.PNG", None), ("embed", "引用推文", "https://x.com/q/status/1", "quoted_post"), ("embed", "视频", "https://x.com/o/status/8", "video")] and (b.external_id, b.quoted_id, b.blocks[0].alt_text, b.blocks[0].mime_type) == ("8", "1", "a", "image/png")
    assert short(c.blocks) == [("paragraph", "RT", None, None), ("image", None, "https://p/r.jpg", None), ("embed", "外部链接", "https://l.example.org", "external_link")] and (c.retweeted_id, c.retweeted_url) == ("3", "https://x.com/r/status/3")
    assert d.rejected and e.rejected


def test_weibo_posts(spark):
    post = {
        "mid": 9, "mblogid": "M", "created_at": "Tue Jan 02 03:04:05 +0800 2024", "text_raw": "<a href='x'>@n</a> said http://t.cn/s1 &amp; more<br>line", "user": {"id": 5, "screen_name": "s"}, "pics": [{"large": {"url": "https://p/l.jpg"}, "url": "https://p/s.jpg"}, {"url": "https://p/2.gif"}], "pic_ids": ["k", ""], "secret": 1,
        "url_struct": [{"short_url": "http://t.cn/s1", "long_url": "https://video.weibo.com/v", "url_title": "V"}, {"url_long": "https://news.example.org/1", "url_title": ""}, {"long_url": "https://news.example.org/1"}], "page_info": {"type": "video", "page_url": "", "page_title": "P"},
        "retweeted_status": {"id": 4, "text": "up", "user": {"idstr": "6", "screen_name": "u"}, "secret": 2},
    }
    poll = {"id": "1", "text": "t", "user": {"idstr": "2"}, "page_info": {"object_type": "hudongvote"}, "retweeted_status": {"text_raw": "gone"}}
    a, b, c = mapped(spark, platforms.weibo_posts, post, poll, {"id": 1, "text": "no author"})
    assert (a.external_id, a.url, a.author, str(a.published_at), a.quoted_id, a.quoted_url) == ("9", "https://weibo.com/5/M", "s", "2024-01-01 19:04:05", "4", "https://weibo.com/6/4")
    assert short(a.blocks) == [
        ("paragraph", "@n\nsaid & more\nline", None, None), ("image", None, "https://p/l.jpg", None), ("image", None, "https://p/2.gif", None), ("image", None, "https://wx1.sinaimg.cn/orj960/k", None),
        ("quote", "转发自 @u：up", None, None), ("embed", "原微博", "https://weibo.com/6/4", "quoted_post"), ("embed", "V", "https://video.weibo.com/v", "video"), ("embed", "网页链接", "https://news.example.org/1", "video"),
    ]
    kept = json.loads(a.response)
    assert "secret" not in kept and kept["retweeted_status"] == {"id": 4, "text": "up", "user": {"idstr": "6", "screen_name": "u"}}
    assert short(b.blocks) == [("paragraph", "t", None, None), ("quote", "转发内容：gone", None, None), ("embed", "hudongvote", "https://weibo.com/2/1", "poll")] and not b.rejected and c.rejected


def test_registry():
    r = connectors.Registry(connectors.Connector("a", None))
    assert r.types() == ["a"] and connectors.REGISTRY.types() == ["baidu_tieba", "manual", "riot_official", "tencent_lol", "weibo", "x_twitter"]
    with pytest.raises(ValueError):
        r.register(connectors.Connector("a", None))
    with pytest.raises(LookupError):
        r.find("b")


def test_collect(spark):
    df = lambda *rs: spark.createDataFrame([(json.dumps(r),) for r in rs], "value string")
    with pytest.raises(ValueError, match="cannot collect"):
        connectors.collect(df(TWEET), "x_twitter", "weibo")
    with pytest.raises(ValueError, match="unsupported"):
        connectors.collect(df(TWEET), "x_twitter", "x_twitter", {"target": 1})
    rows = df(TWEET, {**TWEET, "id_str": "8", "date": "2024-02-01T00:00:00Z"}, {"id_str": "9", "rawContent": ""})
    got = connectors.collect(rows, "x_twitter", "x_twitter", cursor={"watermark": 5, "pending": ["1"]}, truncated=True)
    assert sorted((r.external_id, r.error) for r in got.candidates.collect()) == [("7", None), ("8", None), ("9", "tweet has no text")]
    assert tuple(got.next_cursor.first()) == (5, 1_706_745_600_000_000, ["1", "7", "8"])
    done = connectors.collect(rows, "x_twitter", "x_twitter", cursor={"watermark": 5, "high": 2_000_000_000_000_000, "pending": ["1"]})
    assert tuple(done.next_cursor.first()) == (2_000_000_000_000_000, None, [])
    manual = connectors.collect(df({"title": " T ", "content_blocks": [{"type": "heading", "text": "H", "level": 2}], "published_at": "2024-01-01T00:00:00+00:00", "author": 5, "raw_payload": {"k": 1}}, {"content": "x", "url": "nowhere"}, {}), "manual", "manual").candidates.collect()
    assert [(r.native_title, r.author_name, r.error, [b.text for b in r.blocks]) for r in manual] == [("T", None, None, ["H"]), (None, None, "url must be absolute", ["x"]), (None, None, "no content blocks", [])] and json.loads(manual[0].provenance) == {"k": 1}
    threads = spark.createDataFrame([(1, 0, "user", " first "), (1, 1, "assistant", "no"), (1, 2, "user", "third"), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    t = connectors.collect(threads, "baidu_tieba", "baidu_tieba").candidates.collect()
    assert [(r.external_id, [(b.type, b.text) for b in r.blocks]) for r in t] == [("1", [("heading", "Floor 0"), ("paragraph", "first"), ("heading", "Floor 2"), ("paragraph", "third")])]
    answers = spark.createDataFrame([(1, json.dumps({"status": 0, "msg": "news not found"}), None, None), (2, json.dumps({"status": 1, "data": {"result": {"iDocID": 5, "sContent": "<p>x</p>"}}}), "{}", None)], "answer_id long, value string, discovery string, html string")
    c = connectors.collect(answers, "tencent_lol", "tencent_lol", {"target": "24"}, truncated=True)
    assert sorted((r.external_id, r.skipped, r.error) for r in c.candidates.collect()) == [("1", True, None), ("5", False, None)] and c.next_cursor.first().pending_ids == ["1", "5"]


def test_greedy_choice_against_a_walk(spark):
    rng = random.Random(5)
    for density in (1, 3, 12):
        rows = [(day, i, rng.random()) for day in range(3) for i in range(60)]
        links = [(day, i, rank, rng.randrange(90 // density)) for day, i, rank in rows for _ in range(rng.randint(0, 3))]
        links = list(dict.fromkeys(links))
        want = set()
        for day in range(3):
            seen = set()
            for _, i, rank in sorted((r for r in rows if r[0] == day), key=lambda r: -r[2]):
                mine = {x for d, j, _, x in links if (d, j) == (day, i)}
                if not mine & seen:
                    want.add((day, i))
                    seen |= mine
        got = daily.greedy_disjoint(spark.createDataFrame(rows, "day int, id int, rank double"), spark.createDataFrame(links, "day int, id int, rank double, link int"), ["day"], "rank")
        assert {(r.day, r.id) for r in got.collect()} == want and got.count() == len(want)


def test_reposts_by_account_and_site(spark):
    m = spark.createDataFrame([(1, "repost", False, "https://x.com/Abc/status/1"), (2, "repost", False, "https://twitter.com/none"), (3, "repost", False, "https://news.a.example.org/x"), (4, "original", True, None), (5, "repost", True, "https://weibo.com/u/77"), (6, "repost", True, "https://weibo.com/77")], "id int, content_form string, is_official boolean, upstream string")
    accounts = spark.createDataFrame([("x_twitter", "aBC", True), ("weibo", "77", False), ("weibo", "77", True)], "connector_type string, external_key string, official boolean")
    sites = spark.createDataFrame([("example.org", False), ("x.com", False)], "site string, official boolean")
    got = {r.id: (r.source_kind, r.basis) for r in ops.classification_source(m, sites, accounts).collect()}
    assert got == {1: ("official", "upstream"), 2: ("unknown", "unresolved"), 3: ("unofficial", "upstream"), 4: ("official", "current"), 5: ("unknown", "unresolved"), 6: ("unknown", "unresolved")}
    assert {r.id: r.source_kind for r in ops.classification_source(m, sites).collect()}[1] == "unofficial"


def test_alert_cards(spark):
    row = {"id": 1, "kind": "pipeline_failure", "source_name": " s ", "connector_type": None, "source_id": None, "error_kind": None, "failures": None, "run_id": 3, "stage": "translation", "raw_item_id": 4, "job_id": 5, "checkpoint_id": None, "occurred_at": "now", "error_summary": "x" * 2000}
    schema = "id int, kind string, source_name string, connector_type string, source_id int, error_kind string, failures int, run_id int, stage string, raw_item_id int, job_id int, checkpoint_id int, occurred_at string, error_summary string"
    df = spark.createDataFrame([tuple(row.values()), (2, "other", *[None] * 12)], schema)
    card = json.loads(reviews.alert_cards(df, "Desk").collect()[0].body)
    assert reviews.alert_cards(df).count() == 1 and card["card"]["header"]["title"]["content"] == "🚨 Desk 处理失败"
    text = card["card"]["elements"][0]["text"]["content"].split("\n")
    assert text == ["阶段：翻译", "raw_item：4", "job：5", "run：3", "来源：s", "checkpoint：-", "发生时间：now"] and card["card"]["elements"][2]["text"]["content"].endswith("…") and "text" not in card["card"]["elements"][1]


def test_reports_keep_all_rows(spark, tmp_path):
    df = spark.range(120).withColumn("x", F.concat(F.lit("a|"), F.col("id").cast("string")))
    files.write_report(df, str(tmp_path), "Rows", 100)
    page = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/page").collect())
    assert spark.read.json(f"{tmp_path}/rows").count() == 120 and page.startswith("# Rows") and "there are more" in page and "a\\|99" in page and "a\\|100" not in page
    assert "more" not in files.markdown_table(df.limit(100), 100)


def test_lists(spark):
    runs = spark.createDataFrame([(i, i % 3, "failed" if i % 2 else "completed", i * 10) for i in range(30)], "id int, source_id int, status string, started_us long")
    page, total = lists.run_page(runs, 1, "all", False, 3, 2)
    assert [r.id for r in page.collect()] == [7, 10, 13] and total.first().total == 10
    for bad in ({"status": "odd"}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            lists.run_page(runs, **bad)
    ids = spark.createDataFrame([(3,), (3,), (99,), (None,)], "x int")
    assert [r.id for r in lists.by_ids(runs, ids).collect()] == [3]
    assert lists.newest(spark.range(600).withColumn("at", F.col("id")), "jobs", "at").count() == 500
