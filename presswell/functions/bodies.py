"""Bodies of article pages by the rules of a few sites; a page is parsed once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from presswell.functions.records import extractor

# Where the sites keep their text, the most telling place first; (container, class, inner tag).
PLACES = {
    "lenta": (("div", "topic-body__content", "p"), ("div", "topic-body__content-text", ""), ("div", "topic__text", "p"), ("article", "", "p")),
    "ria": (("div", "article__text", "p"), ("div", "article__body", "p"), ("div", "article__text", ""), ("article", "", "p")),
    "tass": (("div", "news__content", ""), ("div", "news-content", ""), ("div", "article__content", ""), ("article", "", "")),
}
MAX_CHARS, LEAST_BODY = 50_000, 200
_SKIPPED, _VOID = ("script", "style", "noscript"), frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, classes: tuple[str, ...] = ()) -> None:
        self.tag, self.classes, self.inside = tag, classes, []

    def strings(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, _Node):
                yield from x.strings()
            elif x.strip():
                yield x.strip()

    def all(self, tag: str, name: str = "") -> Iterator["_Node"]:
        for x in self.inside:
            if isinstance(x, _Node):
                if x.tag == tag and (not name or name in x.classes):
                    yield x
                yield from x.all(tag, name)


class _Tree(HTMLParser):
    """A page as nodes, without scripts and styles."""

    def __init__(self) -> None:
        super().__init__()
        self.root = _Node("")
        self.open, self.skipping = [self.root], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skipping += 1
        if self.skipping or tag in _VOID:
            return
        if tag in ("p", "li") and self.open[-1].tag == tag:
            self.open.pop()
        node = _Node(tag, tuple((dict(attrs).get("class") or "").split()))
        self.open[-1].inside.append(node)
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.open[-1].inside.append(data)


def _text(node: _Node) -> str:
    return " ".join(" ".join(node.strings()).split())


def _lines(found: list[str]) -> str:
    """Lines of two characters or more, until there are ``MAX_CHARS``."""
    kept, total = [], 0
    for line in found:
        line = " ".join(line.split())
        if len(line) >= 2 and total < MAX_CHARS:
            kept.append(line)
            total += len(line) + 1
    return "\n".join(kept).strip()


def body(html: str | None, site: str) -> str:
    """The text of a page: by its site's places, or else all paragraphs of 60 characters."""
    tree = _Tree()
    tree.feed(html or "")
    if site not in PLACES:
        return _lines([t for t in map(_text, tree.root.all("p")) if len(t) >= 60])
    for tag, name, inner in PLACES[site]:
        nodes = list(tree.root.all(tag, name))
        if site == "tass":
            found = _lines([t for n in nodes[:1] for kind in ("p", "li") for t in map(_text, n.all(kind)) if len(t) >= 20])
            if nodes and len(found) < LEAST_BODY:
                found = _lines([t for s in nodes[0].strings() for t in [" ".join(s.split())] if len(t) >= 20])
        else:
            found = _lines([_text(x) for n in nodes for x in (n.all(inner) if inner else (n,))])
        if len(found) >= LEAST_BODY:
            return found
    return ""


@F.pandas_udf("string")
def _bodies(html: pd.Series, site: pd.Series) -> pd.Series:
    return pd.Series([body(h, s) for h, s in zip(html, site)], dtype=object)


def extracted(html: Column, url: Column) -> Column:
    """The body of a page by the rules of its host."""
    return _bodies(html, extractor(url))
