"""Trees, blocks, references, list pages, envelopes and nested JSON on fixtures and against
independent forms."""

import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pressline.functions import urls as U
from pressline.functions import variants as V
from pressline.sources import html_blocks, official
from pressline.sources.tree import parse


def test_selectors():
    tree = parse('<div id="a" class="x y"><p data-k="v/w">one<b> two</b><p>three<script>no</script></div><ul><li>1<ul><li>2</ul><li>3</ul><br/>tail')
    assert [n.text() for n in tree.select("p")] == ["one two", "three"]
    assert tree.first("#a.x p b").text() == "two" and tree.first("#a .x") is None and tree.first(".z,li").text() == "1 2"
    assert tree.first('p[data-k="v/w"]').text() == tree.first('[data-k*="/w"]').text() == "one two" and tree.first('[data-k="v"]') is None and tree.first("[data-k]").tag == "p"
    assert [n.text() for n in tree.select("li")] == ["1 2", "2", "3"] and [p.tag for p in tree.first("b").up()][:2] == ["p", "div"]


def test_deep_pages_stay_fast():
    assert len(list(parse("<div>" * 30_000 + "<p>x" * 30_000).elements())) == 60_000
    assert [b["text"] for b in html_blocks.page_blocks("<div>" * 5000 + "<p>deep", "https://h/")] == ["deep"]


def _random_page(rng):
    """HTML and the blocks it must give, written side by side."""
    word = lambda: rng.choice(["Ab", "c d", "é", "1"])
    html, blocks = [], []
    for _ in range(rng.randint(0, 8)):
        kind = rng.randrange(8)
        pre, post = rng.choice([("", ""), ("<div class='k'>", "</div>"), ("<section><div>", "</div></section>")])
        w = word()
        if kind == 0:
            n = rng.randint(1, 6)
            h, b = f"<h{n}> {w}\t<i>{w}</i></h{n}>", [("heading", f"{w} {w}", n)]
        elif kind == 1:
            h, b = f"<p>{w} &amp;<br>{w}</p>", [("paragraph", f"{w} & {w}")]
        elif kind == 2:
            h, b = f"<blockquote><p>{w}</p><p>{w}</p></blockquote>", [("quote", f"{w} {w}")]
        elif kind == 3:
            tag = rng.choice(["ul", "ol"])
            h, b = f"<{tag}><li>{w}</li><li> </li><li>{w}<b>{w}</b></li></{tag}>", [("list", [w, f"{w} {w}"], tag == "ol")]
        elif kind == 4:
            h, b = f'<figure><img data-src="i/{len(html)}.JPG?q" alt=" {w} "><figcaption>{w} <b>x</b></figcaption></figure>', [("image", f"https://h.example.org/d/i/{len(html)}.JPG?q", "image/jpeg", w, f"{w} x")]
        elif kind == 5:
            h, b = f'<video title="{w}"><source src="//v.example.org/{len(html)}.mp4"></video>', [("embed", f"https://v.example.org/{len(html)}.mp4", "video", w)]
        elif kind == 6:
            h, b = '<p><iframe src="https://e.example.org/x"></iframe></p><img src="data:image/png;base64,AA"><video></video>', [("embed", "https://e.example.org/x", "iframe", None)]
        else:
            h, b = "<p> </p><script>var p='<p>no</p>'</script><ul></ul><style>p{}</style>", []
        html.append(pre + h + post)
        blocks += b
    return "".join(html), blocks


def _short(b):
    if b["type"] == "image":
        return ("image", b["source_url"], b["mime_type"], b["alt_text"], b["caption"])
    if b["type"] == "embed":
        return ("embed", b["source_url"], b["embed_kind"], b["caption"])
    return (b["type"], b["items"], b["ordered"]) if b["type"] == "list" else (b["type"], b["text"], b["level"]) if b["type"] == "heading" else (b["type"], b["text"])


def test_blocks_against_an_independent_tree(spark):
    rng = random.Random(4)
    made = [_random_page(rng) for _ in range(300)]
    pages = spark.createDataFrame([(i, "https://h.example.org/d/p", f"<nav><p>menu</p></nav><main id='m'>{h}</main><p>after</p>") for i, (h, _) in enumerate(made)], "page_id long, url string, html string").repartition(3)
    got = {}
    for r in html_blocks.html_blocks(pages, "#m").orderBy("page_id", "ord").collect():
        got.setdefault(r.page_id, []).append(_short(r.asDict()))
    assert [got.get(i, []) for i in range(300)] == [b for _, b in made]
    assert html_blocks.html_blocks(pages, "#none").count() == 0


def test_references_against_the_standard_library(spark):
    bases = ["https://h.example.org", "http://h.example.org/", "https://h.example.org/a/b/c?x=1#f", "https://u@h.example.org:81/a/b/"]
    parts = ["..", ".", "", "a", "b;c", "?q=1/../2", "#f/g", "d.e"]
    rng = random.Random(6)
    references = ["", "?y", "#z", "//o.example.org/p", "/", "/..", "/../x", "https://o.example.org/../y", "mailto:a@b", ".", "..", "./", "../", "../../../g", *("/".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(300))]
    rows = spark.createDataFrame([(b, r) for b in bases for r in references if "//" not in r[1:] and not r.startswith("//a")], "b string, r string")
    for r in rows.select("b", "r", U.join_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.r), (r.b, r.r)
    assert spark.sql("select 'HTTPS://A.Example.org/B//?x#y' u").select(U.canonical_url(F.col("u"))).first()[0] == "https://a.example.org/B/"


def _page(items, broken=False):
    data = {"props": {"pageProps": {"page": {"blades": [{"type": "x"}, 7, {"items": "no"}, {"items": items}]}}}}
    return f'<html><script id="__NEXT_DATA__" type="application/json">{"{" if broken else ""}{json.dumps(data)}</script>'


def _item(url, title="T", at="2024-05-01T00:00:00Z", category=None):
    return {"title": title, "publishedAt": at, "category": category, "action": {"payload": {"url": url}}}


def test_list_pages(spark):
    card = lambda href, title, time=True: f'<div class="c"><div><a href="{href}"><img></a></div><div><h2>{title}</h2>{"<time datetime=2024-05-02></time>" if time else ""}</div></div>'
    items = [_item("/en-us/news/dev/a?x", "A &amp; b"), _item("https://www.leagueoflegends.com/en-us/news/dev/a/", "again"), _item("/en-us/news/", "root"), _item("/de-de/news/x/", "elsewhere"), _item(5), "text", {}, _item("/en-us/news/x/c", "", "never"), _item("../news/game-updates/d", 12, "never", {"machineName": "m n"}), _item("/en-us/news/e", at=None, category={})]
    pages = [_page(items), _page([]) + card("/en-us/news/dev/one/", "One") + card("/en-us/news/dev/one", "Twice") + card("/en-us/news/dev/two", "No time", False) + card("https://o.example.org/news/x", "Else") + card("/fr-fr/news/z/y", "Z"), _page(items, broken=True), None, "", "<a href='/news/'>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = [tuple(r) for r in official.list_entries(df).select("page_id", "ord", "url", "title", "published_us", "category", "way").orderBy("page_id", "ord").collect()]
    site, may = "https://www.leagueoflegends.com/", 1_714_521_600_000_000
    assert got == [
        (0, 0, site + "en-us/news/dev/a/", "A & b", may, "dev", "json"), (0, 1, site + "en-us/news/game-updates/d/", "12", None, "m n", "json"), (0, 2, site + "en-us/news/e/", "T", None, "", "json"),
        (1, 0, site + "en-us/news/dev/one/", "One", may + 86_400_000_000, "dev", "links"), (1, 1, site + "en-us/news/dev/two/", "One", may + 86_400_000_000, "dev", "links"), (1, 2, site + "fr-fr/news/z/y/", "Z", may + 86_400_000_000, "z", "links"),
    ]


def test_article_pages(spark):
    rich = '<div data-testid="ArticleRichTextBlade"><p>lead</p><div data-testid="rich-text-html"><h3>Head</h3><p>body</p></div></div><div data-testid="RichTextPatchNotesBlade"><div data-testid="rich-text-html"><p>notes</p></div></div>'
    pages = [(1, "https://H.example.org/a?x", f'<h1 data-testid="title"> My\t title</h1><time datetime="2024-05-01T02:00:00+02:00"></time><span class="author-name">A</span><span data-testid="author-name">B</span>{rich}<p>more</p>'), (2, "https://h.example.org/b/", '<div data-testid="ArticleRichTextBlade"><p>only</p></div>'), (3, "https://h.example.org/c", "<article><p>x</p></article><p>y</p>"), (4, "https://h.example.org/d", "<h1></h1>"), (5, None, None)]
    got = {r.page_id: r for r in official.articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [b.text for b in got[1].blocks] == ["Head", "body", "notes"] and (got[1].title, got[1].author, got[1].published_us) == ("My title", "A, B", 1_714_521_600_000_000)
    assert [b.text for b in got[2].blocks] == ["only"] and [b.text for b in got[3].blocks] == ["x"]
    assert got[4].error == got[5].error == "body is empty" and got[1].error is None and got[1].canonical_url == "https://h.example.org/a/" and len(got[1].external_id) == 64


def test_envelope_lists(spark):
    entry = {"iDocID": 7, "sTitle": " T\t1 ", "sCreated": "2024-01-01 08:00:00", "iIsRedirect": "1", "sRedirectURL": "https://x"}
    answers = [{"status": 1, "data": {"result": [entry, {"iDocID": ""}, 5, {"sTitle": "x"}, {"iDocID": "b", "sCreated": "soon"}]}}, {"status": "0", "msg": " gone "}, {"data": {"result": {"iDocID": 1}}}, {"status": "1", "data": []}]
    df = spark.createDataFrame([*((i, json.dumps(a)) for i, a in enumerate(answers)), (9, "<html>")], "answer_id long, value string")
    got = sorted(tuple(r) for r in official.envelope_list(df).select("answer_id", "docid", "title", "published_us", "redirect", "error").collect() if r.docid or r.error)
    assert got == [(0, "7", "T 1", 1_704_067_200_000_000, "https://x", None), (0, "b", None, None, None, None), (1, None, None, None, None, "list failed: gone"), (9, None, None, None, None, "no JSON")]


def test_nested_leaves(spark):
    deep = "[" * 60 + '"Bottom"' + "]" * 60
    rows = [(1, '{"b":["X",{"c":" x "},2.5,0,false,true,null,""],"a":{"d":[[]],"e":"Y"}}'), (2, deep), (3, '"one"'), (4, "{}"), (5, "7"), (6, None), (7, "[0,[0.0],false]")]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.try_parse_json("j").alias("v"))
    got = {r.id: r.texts for r in V.leaf_texts(df, "id", "v").collect()}
    assert got == {1: ["y", "x", "2.5", "true"], 2: ["bottom"], 3: ["one"], 5: ["7"]}
    places = {tuple(r.path): r.value for r in V.leaves(df, "id", "v").where("id = 1").collect()}
    assert places[(0, 1)] == "Y" and places[(1, 1, 0)] == " x "


def test_key_whitelists(spark):
    df = spark.sql("""select parse_json('{"a":1,"b":{"c":[1,"x"]},"d":null}') v, parse_json('[1]') w""")
    r = df.select(F.to_json(V.only(F.col("v"), ("b", "d", "z"))).alias("only"), F.to_json(V.without(F.col("v"), ("b",))).alias("without"), V.only(F.col("w"), ("a",)).isNull().alias("none")).first()
    assert (json.loads(r["only"]), json.loads(r["without"]), r["none"]) == ({"b": {"c": [1, "x"]}, "d": None}, {"a": 1, "d": None}, True)


@pytest.mark.parametrize("url,kind", [("https://lol.qq.com/act/a20200421weekfree/index.html?siteId=1", "weekly_free"), ("https://LOL.qq.com/gicp/news/5/6.html", "news_page"), ("https://lol.qq.com/x", "unsupported"), ("http://lol.qq.com/x", "external"), ("https://lol.qq.com.example.org/", "external"), ("ftp://x/y", None), ("", None)])
def test_redirects(spark, url, kind):
    assert spark.range(1).select(official.redirect_kind(F.lit(url))).first()[0] == kind
