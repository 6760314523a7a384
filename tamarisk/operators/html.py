"""Blocks of text from web pages: nested inline elements of one comment come out as one text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.session import small_batches

# Elements whose text is not read, elements without an end, and elements that bound a block.
SKIPPED = frozenset(("script", "style", "noscript", "iframe", "textarea", "input", "select", "code", "pre", "svg", "canvas", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCKS = frozenset(("p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "article", "section", "dd", "dt", "figcaption", "main"))
HOPS, LONGEST_BLOCK, KEPT = 6, 2000, 1000
SCHEMA = "page_id long, block_id int, tag string, text string"


class Tree(HTMLParser):
    """Elements with parent, tag and the pieces of their own text, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str]] = [(-1, "")]
        self.own: list[list[str]] = [[]]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        self.nodes.append((self.open[-1], tag))
        self.own.append([])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]][1] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not any(self.nodes[i][1] in SKIPPED for i in self.open):
            self.own[self.open[-1]].append(data)
            self.pieces.append((self.open[-1], data))


def blocks(page: str) -> list[tuple[str, str]]:
    """(tag, text) of each block that holds text of its own or of inline elements, in order, each once.

    An element's block is the nearest block element within six steps up whose whole text has
    at most 2000 characters, else the element itself. White space collapses; 1000 characters stay.
    """
    tree = Tree()
    tree.feed(page)
    tree.close()
    full: list[list[str]] = [[] for _ in tree.nodes]
    for node, data in tree.pieces:
        while node >= 0:
            full[node].append(data)
            node = tree.nodes[node][0]
    whole = [" ".join("".join(x).split()) for x in full]
    out: dict[int, None] = {}
    for node in range(1, len(tree.nodes)):
        if not "".join(tree.own[node]).strip():
            continue
        at, chosen = node, node
        for _ in range(HOPS):
            if at <= 0:
                break
            if tree.nodes[at][1] in BLOCKS:
                if len(whole[at]) <= LONGEST_BLOCK:
                    chosen = at
                break
            at = tree.nodes[at][0]
        out[chosen] = None
    return [(tree.nodes[n][1], whole[n][:KEPT]) for n in out if whole[n]]


def page_blocks(pages: DataFrame, carried: str | None = None) -> DataFrame:
    """(page_id, block_id, tag, text) of pages (page_id, html), after a long ``carried`` if that is named; null pages have none."""
    small_batches(pages.sparkSession)
    more = [carried] if carried else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*own, i, t, x) for *own, h in frame.itertuples(index=False) if isinstance(h, str) for i, (t, x) in enumerate(blocks(h))]
            yield pd.DataFrame(rows, columns=["page_id", *more, "block_id", "tag", "text"])

    schema = SCHEMA.replace("block_id", "".join(f"{c} long, " for c in more) + "block_id")
    return pages.select("page_id", *(F.col(c).cast("long") for c in more), "html").mapInPandas(run, schema)
