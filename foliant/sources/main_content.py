"""The element of a page that holds its content, by scores of all candidates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import arrow_schema, batched_rows
from foliant.sources.markup import SKIPPED, VOID

# Candidate elements, words in class and id for and against content, and the weights of the score.
CANDIDATES = frozenset("article main section div body td".split())
GOOD = frozenset("article body content entry main post story text".split())
BAD = frozenset("ad ads banner breadcrumb combx comment comments community cookie disqus footer header menu nav pager popup promo related remark rss share sidebar sponsor toolbar".split())
BOILERPLATE = frozenset("nav header footer aside form".split())
HEADING, SEMANTIC, NAMED_FOR, NAMED_AGAINST, FRAME, REPEAT = 40, 120, 200, 240, 120, 80
LEAST_CHARS, LEAST_SHARE, MARGIN = 200, 1 / 7, 1.25


@dataclass(eq=False)
class Node:
    tag: str
    tokens: frozenset = frozenset()
    parts: list = field(default_factory=list)
    text: int = 0
    link: int = 0
    paragraphs: int = 0
    headings: int = 0
    semantic: int = 0
    frame: int = 0
    repeat: int = 0
    order: int = 0


class Tree(HTMLParser):
    """A tolerant tree of the page without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack, self.skip, self.count = [self.root], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED or tag == "head":
            self.skip += tag not in VOID
            return
        if self.skip:
            return
        if tag in ("p", "li") and any(n.tag == tag for n in self.stack[-3:]):
            while self.stack.pop().tag != tag:
                pass
        given = dict(attrs)
        words = frozenset(re.findall(r"[a-z0-9]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower()))
        self.count += 1
        node = Node(tag, words, order=self.count)
        self.stack[-1].parts.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if tag in SKIPPED or tag == "head":
            self.skip = max(0, self.skip - 1)
        elif not self.skip and any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.stack[-1].parts.append(data)


def measure(root: Node) -> list[Node]:
    """Sums of each element over what is in it; all elements, parents before children."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [p for p in reversed(n.parts) if isinstance(p, Node)]
    for n in reversed(order):
        own = " ".join(p for p in n.parts if isinstance(p, str)).split()
        kids = [p for p in n.parts if isinstance(p, Node)]
        n.text = len(" ".join(own)) + sum(k.text for k in kids)
        n.link = n.text if n.tag == "a" else sum(k.link for k in kids)
        n.paragraphs = sum(k.paragraphs for k in kids) + (min(n.text, 200) if n.tag == "p" else 0)
        n.headings = sum(k.headings for k in kids) + (n.tag in ("h1", "h2", "h3", "h4"))
        n.semantic = sum(k.semantic for k in kids) + (n.tag in ("table", "pre", "figure", "blockquote", "math"))
        n.frame = sum(k.frame for k in kids) + (n.tag in BOILERPLATE)
        alike = Counter((k.tag, k.tokens) for k in kids if 0 < k.text < 100)
        n.repeat = sum(k.repeat for k in kids) + sum(max(0, c - 2) for (tag, _), c in alike.items() if tag not in ("p", "li", "tr", "td"))
    return order


def score(n: Node) -> float:
    density = n.link / n.text if n.text else 0
    named = NAMED_FOR * bool(n.tokens & GOOD) - NAMED_AGAINST * bool(n.tokens & BAD)
    return n.text + n.paragraphs + HEADING * n.headings + SEMANTIC * n.semantic + named - n.link * (1 + density) - FRAME * n.frame - REPEAT * n.repeat


def select(html: str) -> tuple[Node, str]:
    """(element, how): an article or main, the candidate that clearly leads, or else the whole page."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = measure(tree.root)
    fit = lambda n: (n.text >= LEAST_CHARS or n.semantic >= 2) and n.text >= LEAST_SHARE * tree.root.text
    clear = [n for n in nodes if n.tag in ("article", "main") and not n.tokens & BAD and fit(n)]
    if clear:
        return max(clear, key=lambda n: (score(n), -n.order)), "explicit"
    ranked = sorted((n for n in nodes if n.tag in CANDIDATES and fit(n)), key=lambda n: (-score(n), n.order))
    if ranked:
        best = ranked[0]
        inside = {id(x) for x in measure_ids(best)}
        rival = next((n for n in ranked[1:] if id(n) not in inside and best not in measure_ids(n)), None)
        if rival is None or score(best) >= MARGIN * score(rival):
            return best, "scored"
    return tree.root, "page"


def measure_ids(n: Node) -> list[Node]:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [p for p in x.parts if isinstance(p, Node)]
    return out


def text_of(n: Node) -> str:
    """Visible text without frames, white space single."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is n or (x.tag not in BOILERPLATE and not (x.tokens & BAD)):
            todo += [" ", *reversed(x.parts), " "]
    return " ".join("".join(out).split())


def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(page_id, how, text) of pages (page_id, html); each page's tree goes before the next one is made."""
    def one(html: str) -> tuple[str, str]:
        node, how = select(html)
        return how, text_of(node)

    for batch in batches:
        for page, html in zip(*batch.columns):
            yield page.as_py(), *one(html.as_py() or "")


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, how, text) of pages (page_id, html)."""
    schema = "page_id long, how string, text string"
    arrow = arrow_schema(schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(lambda batches: batched_rows(contents(batches), arrow), schema)
