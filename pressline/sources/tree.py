"""HTML as a tree: parents, siblings and a few selectors, without recursion.

Only what the site parsers need: tag, #id, .class, [name="value"] and [name*="value"],
compounds of them, descendants (blanks) and alternatives (commas)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a start tag closes if they are open inside the nearest of the second set.
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str | None], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node | str]:
        """Descendants in document order: elements and texts."""
        todo = self.children[::-1]
        while todo:
            x = todo.pop()
            yield x
            if not isinstance(x, str):
                todo += x.children[::-1]

    def elements(self) -> Iterator[Node]:
        return (x for x in self.walk() if not isinstance(x, str))

    def text(self, separator: str = " ") -> str:
        """The stripped texts below this element, joined; those of scripts and styles inside it are left out."""
        out, todo = [], self.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.tag not in ("script", "style"):
                todo += x.children[::-1]
        return separator.join(filter(None, out))

    def select(self, selector: str) -> list[Node]:
        tests = _compiled(selector)
        return [x for x in self.elements() if any(_matches(x, path, self) for path in tests)]

    def first(self, selector: str) -> Node | None:
        tests = _compiled(selector)
        return next((x for x in self.elements() if any(_matches(x, path, self) for path in tests)), None)

    def up(self, within: Node | None = None) -> Iterator[Node]:
        """Ancestors from the parent on, below ``within``."""
        p = self.parent
        while p is not None and p is not within:
            yield p
            p = p.parent


_PART = re.compile(r"""([#.]?[\w-]+)|\[\s*([\w-]+)\s*(?:(\*?=)\s*"([^"]*)")?\s*\]""")


@lru_cache(maxsize=256)
def _compiled(selector: str) -> list[list[list[tuple[str, str, str]]]]:
    """Alternatives, each a path of compounds, each a list of (kind, name, value)."""

    def compound(text: str) -> list[tuple[str, str, str]]:
        out = []
        for simple, name, op, value in _PART.findall(text):
            if simple:
                out.append(("id", "id", simple[1:]) if simple[0] == "#" else ("class", "class", simple[1:]) if simple[0] == "." else ("tag", simple.lower(), ""))
            else:
                out.append((op or "has", name.lower(), value))
        return out

    return [[compound(c) for c in re.findall(r'(?:\[[^\]]*\]|[^\s\[])+', alternative)] for alternative in re.split(r',(?![^\[]*\])', selector)]


def _holds(node: Node, compound: list[tuple[str, str, str]]) -> bool:
    for kind, name, value in compound:
        have = node.attributes.get(name) or ""
        if kind == "tag":
            ok = node.tag == name
        elif kind == "class":
            ok = value in have.split()
        elif kind == "*=":
            ok = bool(value) and value in have
        elif kind == "has":
            ok = name in node.attributes
        else:
            ok = have == value
        if not ok:
            return False
    return True


def _matches(node: Node, path: list[list[tuple[str, str, str]]], root: Node) -> bool:
    if not _holds(node, path[-1]):
        return False
    rest = len(path) - 2  # ancestors are taken greedily from below, which finds a match if there is one
    for p in node.up():
        if rest < 0:
            break
        if _holds(p, path[rest]):
            rest -= 1
    return rest < 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.open: Counter[str] = Counter()  # open elements by tag, so that most searches need not begin

    def _innermost(self, tags, fence) -> list[Node]:
        """The open elements of ``tags`` inside the nearest one of ``fence``, from below."""
        found, x = [], self.here
        if any(self.open[t] for t in tags):
            while x is not self.root and x.tag not in fence:
                if x.tag in tags:
                    found.append(x)
                x = x.parent
        return found

    def _close(self, node: Node) -> None:
        while True:
            x = self.here
            self.open[x.tag] -= 1
            self.here = x.parent
            if x is node:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _P_ENDS and (found := self._innermost({"p"}, {"button", "td", "th", "table"})):
            self._close(found[-1])
        if tag in _ENDS and (found := self._innermost(*_ENDS[tag])):
            self._close(found[-1])
        node = Node(tag, dict(reversed(attrs)), self.here)  # of repeated names the first counts
        self.here.children.append(node)
        if tag not in VOID:
            self.open[tag] += 1
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if self.open[tag]:
            x = self.here
            while x.tag != tag:
                x = x.parent
            self._close(x)

    def handle_data(self, data):
        if self.here.children and isinstance(self.here.children[-1], str):
            self.here.children[-1] += data
        else:
            self.here.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
