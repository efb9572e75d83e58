"""Operator 3 - HTML extraction by shallow text features and a decision tree.

A page is cut into flat *blocks* of text at block-level tags (and ``<br>``);
scripts, styles, comments, titles and the like are no text.  A block's features
are its word count and link density (share of its words inside ``<a>``), and
those of the blocks before and after it (0 at the page's ends).  A decision
tree (CART, Gini) says which blocks are content.  It is trained here on
``LABELLED``, a small hand-labelled table of pages' blocks.

Pages are scanned by one regular expression that never goes back over what it
has read, and whose every step in a tag is bounded by the next ``<``, so the
time is linear in a page's length, however broken it is.  As in browsers quotes
delimit an attribute's value after ``=`` only, so ``<a "x> y" z`` is a tag up to
its ``>``; a value that holds ``<`` isn't taken for quoted.  What opens like a
tag and isn't closed before the next ``<`` is text.

One row for each input row, repeated ones too, in no order: a null page has
null text and counts, an empty one (or one without content) empty text, a null
``page_id`` stays null.  An unclosed comment or script lasts to the page's end;
an unclosed link to the end of its block.  Entities are decoded and white space
is a single space; blocks are joined by line ends.  Equal features are equally
classified; pages are read whole, however long.  Columns other than
``page_id`` and ``html`` aren't read, whatever their names; an empty table has
no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import require, table, tuned

DEPTH, LEAST = 5, 2

#: Pages as blocks (words, words in links, content): news, blogs, shops,
#: forums, documentation, link lists; with and without footers and titles.
LABELLED = [
    [(1, 1, 0), (1, 1, 0), (1, 1, 0), (2, 2, 0), (1, 1, 0), (8, 0, 0), (9, 0, 1), (64, 0, 1), (120, 3, 1), (4, 0, 1), (85, 0, 1), (12, 0, 0)],
    [(2, 2, 0), (1, 1, 0), (3, 3, 0), (1, 1, 0), (5, 0, 0), (12, 0, 1), (45, 1, 1), (33, 0, 1), (70, 0, 1), (2, 0, 1), (9, 1, 0)],
    [(1, 1, 0), (1, 1, 0), (1, 1, 0), (11, 0, 0), (7, 0, 1), (22, 0, 1), (15, 0, 1), (9, 0, 1), (31, 2, 1), (6, 0, 1), (14, 0, 0)],
    [(4, 4, 0), (4, 4, 0), (3, 3, 0), (10, 0, 1), (3, 0, 1), (140, 5, 1), (98, 2, 1), (1, 0, 1), (3, 0, 1), (51, 0, 1), (5, 5, 0), (6, 6, 0), (10, 4, 0)],
    [(1, 1, 0), (2, 2, 0), (15, 0, 0), (11, 0, 1), (13, 0, 1), (210, 0, 1), (16, 2, 0), (3, 3, 0), (3, 3, 0)],
    [(1, 1, 0), (1, 1, 0), (6, 0, 0), (6, 0, 1), (27, 0, 1), (5, 0, 1), (2, 0, 1), (5, 0, 1), (60, 0, 1), (8, 0, 0)],
    [(3, 3, 0), (2, 2, 0), (4, 0, 0), (2, 1, 0), (3, 2, 0), (2, 1, 0), (5, 3, 0), (2, 2, 0), (4, 4, 0), (7, 2, 0)],
    [(20, 18, 0), (25, 22, 0), (12, 12, 0), (30, 24, 0), (16, 11, 0), (7, 7, 0)],
    [(14, 0, 1), (52, 0, 1), (38, 1, 1), (75, 0, 1)],
    [(8, 0, 1), (130, 4, 1), (220, 6, 1), (90, 1, 1), (17, 0, 0), (2, 2, 0), (1, 1, 0)],
    [(1, 1, 0), (9, 0, 0), (8, 0, 1), (40, 0, 1), (19, 0, 1), (3, 0, 1), (26, 0, 1), (10, 0, 1), (13, 0, 0)],
    [(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (14, 0, 0), (10, 0, 1), (11, 0, 1), (300, 0, 1), (5, 0, 1), (10, 0, 0)],
    [(2, 2, 0), (2, 2, 0), (2, 2, 0), (18, 0, 0), (9, 0, 1), (8, 0, 1), (18, 0, 1), (42, 0, 1), (16, 1, 0)],
    [(1, 1, 0), (1, 1, 0), (7, 0, 0), (12, 0, 1), (48, 0, 1), (20, 0, 1)],
    [(1, 1, 0), (2, 2, 0), (10, 0, 0), (10, 0, 1), (10, 0, 1), (12, 0, 0)],
    [(1, 1, 0), (1, 1, 0), (12, 0, 0), (3, 0, 1), (3, 0, 1), (6, 0, 1), (11, 0, 0)],
    [(5, 0, 1)],
    [(3, 0, 1)],
    [(12, 0, 1)],
    [(4, 4, 0)],
]

_INLINE = "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split()
_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|title|iframe|select)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*+)(?:[^<>=]++|=\s*+"[^"<]*+"|=\s*+'[^'<]*+'|=)*+>"""
    r"|<[!?][^<>]*>",
    re.S | re.I,
)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """``(text, words, words in links)`` of a page's blocks, in order."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        words = html.unescape("".join(parts)).split()
        parts.clear()
        if words:
            out.append((" ".join(words), len(words), min(len(words), len(html.unescape("".join(linked)).split()))))
        linked.clear()

    def text(s: str) -> None:
        parts.append(s)
        if in_link:
            linked.append(s)

    for m in _SCAN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m.group(2)
            linked.append(" ")
        elif name not in _INLINE:
            flush()
            if m.group(2):
                in_link = False
    if at < len(page):
        text(page[at:])
    flush()
    return out


def features(sizes: np.ndarray, links: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each block: words and link density before, own, after.
    ``first`` is true where a page begins."""
    n = len(sizes)
    density = links / np.maximum(sizes, 1)
    last = np.append(first[1:], True) if n else first
    before, after = np.arange(n) - 1, np.minimum(np.arange(n) + 1, n - 1)
    return np.stack([np.where(first, 0, sizes[before]), np.where(first, 0, density[before]), sizes, density, np.where(last, 0, sizes[after]), np.where(last, 0, density[after])], 1) if n else np.zeros((0, 6))


@dataclass
class Node:
    value: bool
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def classify(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        side = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[side], out[~side] = self.low.classify(x[side]), self.high.classify(x[~side])
        return out


def train(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST) -> Node:
    """CART: the split of the smallest Gini impurity, down to ``depth`` levels
    and ``least`` rows a leaf; the first feature and cut among equals."""
    node = Node(bool(y.mean() >= 0.5) if len(y) else True)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
        cost = 2 * (a * (1 - a) * n + b * (1 - b) * (len(y) - n))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(cost.argmin())
        if cost[k] < best:
            best, node.feature, node.cut = cost[k], f, (v[k] + v[k + 1]) / 2
    if node.feature >= 0:
        side = x[:, node.feature] <= node.cut
        node.low, node.high = train(x[side], y[side], depth - 1, least), train(x[~side], y[~side], depth - 1, least)
    return node


def labelled_tree(pages: list[list[tuple[int, int, int]]] = LABELLED) -> Node:
    rows = np.array([b for p in pages for b in p])
    first = np.array([i == 0 for p in pages for i in range(len(p))])
    return train(features(rows[:, 0], rows[:, 1], first), rows[:, 2])


def extract_all(pages: list[str | None], tree: Node) -> list[tuple[str | None, int | None, int | None]]:
    """``(text, blocks, content blocks)`` of each page."""
    found = [None if p is None else blocks(p) for p in pages]
    flat = [b for p in found if p for b in p]
    first = np.array([i == 0 for p in found if p for i in range(len(p))], bool)
    x = features(np.array([b[1] for b in flat], np.int64), np.array([b[2] for b in flat], np.int64), first)
    keep, at, out = tree.classify(x).tolist(), 0, []
    for p in found:
        if p is None:
            out.append((None, None, None))
            continue
        texts = [b[0] for b, k in zip(p, keep[at : at + len(p)]) if k]
        at += len(p)
        out.append(("\n".join(texts), len(p), len(texts)))
    return out


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """``(page_id, text, blocks, content_blocks)``, a row for each page."""
    require(pages, "page_id", "html")
    tree = tree or labelled_tree()
    tuned(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                text, n, kept = zip(*extract_all(part.column("html").to_pylist(), tree))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "blocks", "content_blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, blocks int, content_blocks int")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
