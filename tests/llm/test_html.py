"""Main-text extraction: exact texts of hard pages, and an independent extractor on all generated pages."""

from html.parser import HTMLParser

import pytest

from pressline.llm import html_extract

CASES = {
    "nested": ("<div>" * 5000 + "<p>hello world</p>" + "</div>" * 5000, "hello world"),
    "cdata": ("<nav><![CDATA[menu]]></nav><article><p>text</p></article>", "text"),
    "stray quote": ('<p class="x>hello', "hello"),
    "stray quote, more tags": ('<div><p class="x>hello</p><p class="y">bye</p></div>', "hello\nbye"),
    "quoted markup": ("<article><p data-x=\"<b>no</b>\" title='a > b'>yes</p></article>", "yes"),
    "math": ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", "Let x=1 be."),
    "script in a line": ('<article><p>one <script>var a="</p>";</script>two <svg><text>no</text></svg>three</p></article>', "one two three"),
    "article parts": (
        '<article><header><h1>Title</h1></header><p class="social-history">S.</p><div class="widget-quote"><p>Q.</p></div><p>T.</p></article>',
        "Title\nS.\nQ.\nT.",
    ),
    "comments": ('<article><p>T.</p><div class="comments"><p>C</p></div><ul class="comment-list"><li>x</li></ul><div id="reader_comments">y</div></article>', "T."),
    "quotation footer": ("<article><blockquote><p>Q</p><footer>Who</footer></blockquote><footer>end</footer></article>", "Q\nWho"),
    "form around the page": ('<form id="f"><div><nav>n</nav><article><p>body text here</p></article><p>ask</p></div></form>', "body text here"),
    "code comment": ('<article><pre>x = 1 <span class="comment"># why</span></pre></article>', "x = 1 # why"),
    "advert in a line": ('<article><p>a <span class="ad">buy</span>b</p></article>', "a b"),
    "unknown elements": ("<article><p>a <x-y>b</x-y> c</p></article>", "a b c"),
    "title beside content": ('<article><h1>Head</h1><div class="content"><p>One long paragraph of the article.</p><p>And another one.</p></div></article>', "Head\nOne long paragraph of the article.\nAnd another one."),
    "title before content": ('<body><div class="page"><header>site</header><h1>Head</h1><div class="content"><p>One long paragraph.</p></div><div class="more"><p>x</p></div></div></body>', "Head\nOne long paragraph."),
    "lead plus body": ('<body><div class="story"><div class="lead"><p>Lead text.</p></div><div class="body"><p>The body of the story, which is longer.</p></div></div><div class="other"><p>z</p></div></body>', "Lead text.\nThe body of the story, which is longer."),
    "lead in an article": ('<main><article><p class="lead">Lead.</p><div class="entry-content"><p>The body of the article goes on for longer than that.</p></div><aside>no</aside></article><div><p>Next story</p></div></main>', "Lead.\nThe body of the article goes on for longer than that."),
    "main with links": ('<main><div class="text"><p>Story text here.</p></div><ul><li><a href="/1">Another story with a long name</a></li><li><a href="/2">And yet another story</a></li></ul></main>', "Story text here."),
    "references and spaces": ("<article><p>a&nbsp;&amp;\n\t b<br>c</p>\n<p> &#233;​ </p></article>", "a & b c\né​"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_exact_text(name):
    page, text = CASES[name]
    assert html_extract.extract(page, None) == text


class Simple(HTMLParser):
    """Lines of the article element, for pages without nested furniture."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.lines[-1] += " "
        elif tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.lines.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        lines = [" ".join(x.split()) for x in Simple(r.html or "").lines]
        text = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (text, len(text))


def test_paths_vote_by_host(spark):
    """A page whose best container is not on its host's path is extracted from the path."""
    usual = '<div class="story"><p>{}</p></div><div class="more"><p>x</p></div>'
    odd = '<div class="story"><p>short</p></div><div class="more"><p>much longer than the story itself</p></div>'
    rows = [(i, "http://www.h.org/1", usual.format("word " * 30)) for i in range(3)] + [(9, "https://h.org/2", odd), (10, "http://other.org", odd)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short" and got[10] == "much longer than the story itself"


def test_winning_path_that_meets_a_teaser(spark):
    """A host's path that holds but a teaser on one page gives way to the page's own best."""
    usual = '<body><div class="box"><p>{}</p></div></body>'
    odd = '<body><div class="box"><p>Read on</p></div><article><h1>Title</h1><p>{}</p></article></body>'
    rows = [(i, "http://h.org/1", usual.format("word " * 60)) for i in range(5)] + [(9, "http://h.org/2", odd.format("text " * 100))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Title\n" + ("text " * 100).strip() and got[0] == ("word " * 60).strip()
