"""Main-text extraction with consensus host paths.

Each page scores its containers: a text block counts for its parent, and with less
weight for the ancestors above, by the length of its text outside links. The best
container votes with its generalised path (tags and classes from the root, numbers
replaced) for the host. Spark adds up the votes per host and path, and every page
is extracted again from the containers on its host's winning path. A page without
that path uses its own best container.

The best container is often the inner part of an article. Before it votes it is
widened to the nearest article element, or else to the outermost container around it
that says to be the main part and is mostly this text. A heading of the first level that stands
before a container without one belongs to it. Where the winning path of a host holds less
than ``LEAST_SHARE`` of what the page's own best container has, it met a teaser and the
page's own is taken.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by their element, or by a class, id or role all of
whose words say so: ``comment-list`` is left out, ``social-history`` is not. The
header of an article and the footer of a quotation belong to the text. Everything
else of the container is kept, in page order, one line a block.

Defined cases: null or empty html gives an empty text; pages without a usable url
vote as one host; a page without elements is its own container; a quote that is never
closed ends with its tag; nesting may have any depth and a page any length (both cost
time in proportion); ties between paths go to the path met by the smallest name;
repeated rows are extracted row by row; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Inside a tag: a quoted value that holds a > must be followed by what may follow a value,
#: else its quote is a stray one. The possessive repeats keep the match linear.
_IN_TAG = r"""((?:[^>"']++|"[^">]*+"|'[^'>]*+'|"[^"]*+"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|["'])*+)"""
MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*){_IN_TAG}(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NUMBER = re.compile(r"\d+")
WORD = re.compile(r"[a-z]+")

#: Classes that tell a state of the layout, as in has-sidebar, and not what the element is.
STATE = re.compile(r"(?:has|with|without|no|is|js|not)[-_]")

# Fixed values of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript iframe textarea title noembed noframes xmp".split())
#: Elements that begin and end a block; all others stand within one.
BLOCK = frozenset("""
#root html body head address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup
option p pre search section summary table tbody td tfoot th thead tr ul xmp
""".split())
DROPPED = frozenset("""
nav header footer aside form button select option fieldset dialog menu head input datalist audio video map
svg object canvas template annotation annotation-xml search
""".split())
DROPPED_WORDS = frozenset("""
nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar
ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion promoted sponsor sponsored
cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall
newsletter subscribe subscription signup login
comment comments disqus respond reply replies discussion share sharing social related recommended recommendations
teaser teasers widget widgets pagination pager search skip copyright disclaimer
""".split())
#: Of these, the words that also hold for elements within a line.
INLINE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored".split())
#: Words that say nothing on what an element is.
NEUTRAL = frozenset("""
area articles bar block bottom box btn button buttons card cards col column container content desktop element fixed form
global google group header heading icon icons inner item items left link links list main mobile module outer page panel
post posts primary reader region right row secondary section site slot small sticky stories text title to top unit user
users view wp wrap wrapper
""".split())
#: Class or id values that are page headers; an article's own heading block is none.
HEADERS = frozenset("header site-header page-header top-header main-header global-header siteheader pageheader header-top header-wrapper".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody content post entry story body main text".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
#: tag -> open tags that it closes, up to the given barrier.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that keep a paragraph outside from being closed.
SCOPE = frozenset("article section div td th li table body main aside header footer nav form blockquote html button caption object".split())
#: An end tag inside one of these closes nothing outside, unless it is of the table.
TABLE_SCOPE, TABLE_TAGS = frozenset("table td th caption object template".split()), frozenset("table tbody thead tfoot tr td th caption body html object template".split())
#: Blocks that count for the element around them.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt".split())
#: Hosts whose winning paths are sent to every task.
SENT_HOSTS = 100_000
#: Weight of a block for its parent, grandparent and so on.
DECAY = (1.0, 0.75, 0.55, 0.4, 0.25, 0.15)
#: Labels of a path that are written out; the key tells longer ones apart.
SHOWN = 32

#: Share of the own best container's text below which a host's path is not believed.
LEAST_SHARE = 0.05

KEPT, IN_FORM, LEFT_OUT = 0, 1, 2


def _tells_boilerplate(name: str, known: frozenset[str]) -> bool:
    """Every word of a class or id that says something is of page furniture."""
    telling = [w for w in WORD.findall(name) if w not in NEUTRAL]
    return bool(telling) and all(w in known for w in telling)


class Node:
    """An element: its place (key, a hash of the labels from the root), whether its text
    is left out, and what its children inherit."""

    __slots__ = ("tag", "parent", "label", "key", "state", "main", "article", "block", "in_paragraph", "in_quote", "linked", "score", "hit", "total", "links")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.label, self.main, self.score, self.hit = tag, parent, tag, tag in MAIN, 0.0, False
        self.total = self.links = 0  # characters of kept text inside, and of those in links
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.linked = tag == "a" or (parent is not None and parent.linked and self.block is not self)
        self.in_paragraph = tag == "p" or (parent is not None and parent.in_paragraph and tag not in SCOPE)
        self.in_quote = tag == "blockquote" or (parent is not None and parent.in_quote)
        self.article = tag in MAIN or (parent is not None and parent.article)
        self.state = KEPT if parent is None else parent.state
        if tag in DROPPED and not (tag == "header" and self.article) and not (tag == "footer" and self.in_quote):
            self.state = max(self.state, IN_FORM if tag == "form" else LEFT_OUT)
        elif tag in MAIN and self.state == IN_FORM:  # a form around the whole page
            self.state = KEPT
        if attributes and not attributes.isspace():
            self._read(attributes)
        self.key = xxhash.xxh64_intdigest(self.label, parent.key if parent is not None else 0)

    def _read(self, attributes: str) -> None:
        at = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
        classes = at.get("class", "").split()
        names = [n for n in (*classes, at.get("id", "")) if n and not STATE.match(n)]
        furniture = any(_tells_boilerplate(n, DROPPED_WORDS if self.block is self else INLINE_WORDS) for n in names)
        furniture = furniture or (self.block is self and not self.article and bool(HEADERS & set(names)))
        role, prop = at.get("role", ""), at.get("itemprop", "")
        self.main = self.main or role == "main" or prop == "articlebody" or (not furniture and any(w in MAIN_WORDS for n in names for w in WORD.findall(n)))
        hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")
        if hidden or (self.tag not in ("html", "body") and (furniture or role in DROPPED_ROLES)):
            self.state = LEFT_OUT
        self.label = ".".join([self.tag, *sorted(NUMBER.sub("#", c) for c in classes)])

    def path(self) -> str:
        out, node = [], self
        while node is not None and len(out) < SHOWN:
            out.append(node.label)
            node = node.parent
        return ">".join(reversed(out))


class Page:
    """Blocks of text of one page, each with the block element that holds it."""

    def __init__(self, source: str):
        self.nodes = [Node("#root", None)]
        self.blocks: list[tuple[Node, str, int]] = []
        self.stack = [self.nodes[0]]
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self.stack[-1].block, text, self._linked))
            self._text, self._linked = [], 0

    def _add(self, text: str) -> None:
        top = self.stack[-1]
        if top.state == KEPT:
            self._text.append(text)
            if top.linked:
                self._linked += len(text)

    def _push(self, tag: str, attributes: str) -> None:
        node = Node(tag, self.stack[-1], attributes)
        self.nodes.append(node)
        self.stack.append(node)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, i: int) -> None:
        for node in self.stack[i:]:
            self._open[node.tag] -= 1
        del self.stack[i:]

    def _implied(self, tag: str) -> None:
        """Close what a start tag closes by itself: an open paragraph, list items, cells."""
        if tag in CLOSES_PARAGRAPH and self.stack[-1].in_paragraph:
            self._pop_to(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == "p"))
        if tag in IMPLIED:
            closes, barrier = IMPLIED[tag]
            if not any(self._open.get(t) for t in closes):
                return
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in barrier:
                    break
                if self.stack[i].tag in closes:
                    self._pop_to(i)
                    if tag != "tr":
                        break

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = MARKUP.search(source, at)
            text = source[at : m.start() if m else end]
            if text:
                self._add(html.unescape(text) if "&" in text else text)
            if m is None:
                break
            at = m.end()
            if m[1] is not None:
                self._add(m[1])
            if m[3] is None:
                continue
            tag = m[3].lower()
            if tag == "br":  # white space inside its block
                self._add(" ")
            elif m[2]:
                self._close(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                if tag == "xmp":
                    self._flush()
                    self._add(source[at : close.start() if close else end])
                    self._flush()
                at = close.end() if close else end
            else:
                if tag in BLOCK:
                    self._flush()
                    self._implied(tag)
                if tag not in VOID and not (m[4].endswith("/") and tag in ("svg", "math")):
                    self._push(tag, m[4])
        self._flush()

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[i].tag
            if open_tag == tag:
                self._pop_to(i)
                return
            if (tag not in BLOCK and open_tag in BLOCK) or (open_tag in TABLE_SCOPE and tag not in TABLE_TAGS):
                return

    def best(self) -> Node | None:
        """The container with the highest score, the first of equals, widened."""
        first: Node | None = None
        for holder, text, linked in self.blocks:
            holder.total += len(text)
            holder.links += min(linked, len(text))
            worth = max(len(text) - linked, 0)
            node = holder.parent if holder.tag in LINES and holder.parent is not None else holder
            for d in DECAY:
                if node is None:
                    break
                node.score += d * worth * (1.5 if node.main else 1.0)
                node = node.parent
        for node in reversed(self.nodes):  # children come after their parents
            if node.parent is not None:
                node.parent.total += node.total
                node.parent.links += node.links
        for node in self.nodes:
            if node.block is node and node.score and (first is None or node.score > first.score):
                first = node
        return self._widened(first) if first is not None else None

    def _widened(self, node: Node) -> Node:
        wider, around = node, node
        while around is not None and around.tag not in ("body", "html", "#root"):
            if around.tag == "article":
                return around
            if around.main and around.total <= 2 * node.total and 2 * around.links <= around.total:
                wider = around
            around = around.parent
        return wider

    def text_of(self, key: int) -> str | None:
        """Blocks inside the containers with that key, and the heading before them; None
        if the page has none."""
        for node in self.nodes:  # parents come before their children
            node.hit = node.key == key or (node.parent is not None and node.parent.hit)
        at = [i for i, (holder, _, _) in enumerate(self.blocks) if holder.hit]
        if not at:
            return None
        if not any(self.blocks[i][0].tag == "h1" for i in at):
            at = [*[i for i in range(at[0]) if self.blocks[i][0].tag == "h1"][-1:], *at]
        return "\n".join(self.blocks[i][1] for i in at)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def vote(source: str | None) -> tuple[int | None, str | None, float]:
    """Key, path and score of the page's best container."""
    best = Page(source or "").best()
    return (_signed(best.key), best.path(), float(best.total)) if best is not None and best.total > 0 else (None, None, 0.0)


def extract(source: str | None, key: int | None) -> str:
    page = Page(source or "")
    best = page.best()
    own = page.text_of(best.key) if best is not None else None
    text = page.text_of(key & 0xFFFFFFFFFFFFFFFF) if key is not None else None
    if text is None or (own is not None and len(text) < LEAST_SHARE * len(own)):
        text = own
    return text or ""


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, key, path: the container path with the most votes; a page's votes are its
    score's logarithm, so that no single long page decides."""

    def run(it):
        for b in it:
            votes = [vote(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), *(pa.array([v[i] for v in votes], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64())))], names=["host", "key", "path", "score"])

    voted = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, key long, path string, score double").where("key is not null")
    summed = voted.groupBy("host", "key").agg(F.min("path").alias("path"), F.sum(F.round(F.log2(1 + F.col("score")), 3).cast("decimal(38,3)")).alias("votes"))
    best = F.min_by(F.struct("key", "path"), F.struct((-F.col("votes")).alias("v"), "path", "key"))
    return summed.groupBy("host").agg(best.alias("b")).select("host", "b.key", "b.path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, path (the host's winner), text, n_chars."""

    def run(it):
        for b in it:
            texts = [extract(h, k) for h, k in zip(b.column("html").to_pylist(), b.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), b.column("path"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "path", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    # pages are the large side and one host may hold a third of them: the winners are
    # sent to the pages if they are few, and only a larger table is joined by shuffle,
    # where Spark splits the partitions of large hosts
    winners = cut_lineage(host_paths(pages))
    if winners.count() <= SENT_HOSTS:
        winners = F.broadcast(winners)
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "key", "path")
    return joined.mapInArrow(run, "page_id long, url string, path string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
