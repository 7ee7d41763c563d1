"""Operator 1: main text of HTML pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Nodes. A page is read once into a tree: elements with parent, depth, end of subtree and the text they hold
themselves. Scripts, styles, comments, titles, text areas and other elements that hold no page text are left out; elements that HTML lets
go unclosed end where the next one implies it. Features of a node: density of text and links in its subtree,
depth, place in the page, how it compares with its siblings and its parent, and what its tag and the words of its
class, id and role attributes tell, by themselves and over all its ancestors.

Trees. Boosted oblivious trees tell each node's chance to be of the main text. They are trained on pages made by
``html_pages``, always the same.

Decoding. On each way down from the root a page is first outside the main text, may enter it, and may leave it
again for good (an advert in an article). The best such labelling of the whole tree is found by dynamic
programming over the nodes' chances; so no node contradicts its ancestors. Inline elements go with their block.

Text. Character references are decoded, white space inside a block is one space, blocks are joined in page
order by an empty line. A <br> is white space. Nothing is cut or dropped for its length.

Cases: null and empty html, and pages without main text, give an empty text and n_chars 0. Broken markup is read
as far as it goes. Repeated rows each have their row. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import pages
from .shared import slices, small_batches

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-gold|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. That of the first kind isn't markup and ends at the first closing tag, or never; the others
#: may hold others of their kind, and those that are never closed are taken for empty, as is whatever closes itself.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
SKIPPED = RAW | frozenset("template object svg math audio video canvas".split())
#: Open elements behind which an open <p> isn't looked for.
KEEPS_P = frozenset("table button object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open <p>.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: tag: (tags that it ends, tags behind which it doesn't look)
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
CONTROLS = frozenset("input button select textarea label option form".split())


class Forest:
    """Nodes of many pages, in page order: each page's first node is its root."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []  # the node behind the subtree
        self.tag: list[str] = []
        self.names: list[tuple[str, ...]] = []
        self.gold: list[int] = []
        self.roots: list[int] = []
        self.segments: list[tuple[int, int, str]] = []  # node, block, text
        self.blocks = 0

    def add(self, source: str) -> None:
        parent, depth, end, tags, names, gold = self.parent, self.depth, self.end, self.tag, self.names, self.gold

        def open_(tag: str, attributes: str, above: int) -> int:
            node = len(parent)
            parent.append(above)
            depth.append(depth[above] + 1 if above >= 0 else 0)
            end.append(-1)
            tags.append(tag)
            own: tuple[str, ...] = ()
            marked = 0
            if "=" in attributes:
                for key, value in ATTRIBUTE.findall(attributes):
                    if key == "data-gold":
                        marked = 1
                    else:
                        own += tuple(w.lower() for w in NAME.findall(value))
            names.append(own)
            gold.append(marked)
            return node

        root = open_("#page", "", -1)
        self.roots.append(root)
        stack = [root]
        places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
        closings: dict[str, tuple] = {}

        def close_from(k: int) -> None:
            for node in stack[k:]:
                end[node] = len(parent)
                places[tags[node]].pop()
            del stack[k:]

        def innermost(some: frozenset[str]) -> int:
            return max((places[t][-1] for t in some if places.get(t)), default=0)

        def behind(tag: str, at: int) -> int:
            """The place behind a skipped element's content, ``at`` if it is never closed."""
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                return close.end() if close else len(source)
            if tag not in closings:  # each of its tags once: where it begins, and by depth where tags that end an element get there
                starts, ends, depths, falls = [], [], [0], defaultdict(list)
                for k, m in enumerate(re.compile(rf"<(/?){tag}\b([^>]*)>", re.I).finditer(source)):
                    starts.append(m.start())
                    ends.append(m.end())
                    depths.append(depths[-1] + (-1 if m[1] else 0 if m[2].endswith("/") else 1))
                    if m[1]:
                        falls[depths[-1]].append(k)
                closings[tag] = starts, ends, depths, falls
            starts, ends, depths, falls = closings[tag]
            k = bisect_left(starts, at)
            below = falls.get(depths[k] - 1, ())
            j = bisect_left(below, k)
            return ends[below[j]] if j < len(below) else at

        self.blocks += 1
        block = self.blocks
        at, n = 0, len(source)
        segments = self.segments
        while at < n:
            m = TOKEN.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                text = source[at:stop]
                if not text.isspace():
                    segments.append((stack[-1], block, text))
                else:
                    segments.append((stack[-1], block, " "))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if places.get(tag):
                    close_from(places[tag][-1])
                if tag not in INLINE:
                    block += 1
                continue
            if tag not in INLINE:
                block += 1
            else:
                if tag == "br" or tag == "img":
                    segments.append((stack[-1], block, " "))
                    continue
            if tag in ENDS_P and places.get("p") and innermost(KEEPS_P) < places["p"][-1]:
                close_from(places["p"][-1])
            if tag in ENDS:
                ended, stops = ENDS[tag]
                stop = innermost(stops)
                if tag == "tr":  # ends the row and its cells
                    inside = [p for t in ended for p in places.get(t, ()) if p > stop]
                    if inside:
                        close_from(min(inside))
                elif innermost(ended) > stop:
                    close_from(innermost(ended))
            attributes = m[3] or m[6] or ""
            node = open_(tag, attributes, stack[-1])
            closed = attributes.endswith("/")
            if tag in SKIPPED:
                at = at if closed else behind(tag, at)
                end[node] = len(parent)
            elif tag in VOID or closed and tag not in ENDS_P and tag not in ("a", "span", "b", "i"):
                end[node] = len(parent)
            else:
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
        for node in stack:
            end[node] = len(parent)
        self.blocks = block + 1

    def page_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.roots)), np.diff([*self.roots, len(self.parent)]))


def _under(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[end] - upto[np.arange(len(end))]


def _down(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], best) -> np.ndarray:
    """best of a node's value and its ancestors'."""
    out = values.copy()
    for level in levels[1:]:
        out[level] = best(out[level], out[parent[level]])
    return out


class Odds:
    """Smoothed log odds of names, from labelled nodes; names not seen tell nothing."""

    def __init__(self, lists: list, label: np.ndarray):
        ones: dict[str, list[float]] = {}
        for own, y in zip(lists, label.tolist(), strict=True):
            for w in set(own):
                ones.setdefault(w, [0.0, 0.0])[y] += 1
        total = [float((label == 0).sum()), float((label == 1).sum())]
        self.table = {w: float(np.log((b + 1) / (total[1] + 2)) - np.log((a + 1) / (total[0] + 2))) for w, (a, b) in ones.items() if a + b >= 3}

    def of(self, lists: list) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most of each list; 0 where nothing is known."""
        get = self.table.get
        found = [[get(w, 0.0) for w in own] if own else None for own in lists]
        low = np.fromiter((min(0.0, *f) if f else 0.0 for f in found), np.float64, len(lists))
        high = np.fromiter((max(0.0, *f) if f else 0.0 for f in found), np.float64, len(lists))
        return low, high


def features(forest: Forest, tag_odds: Odds | None = None, name_odds: Odds | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature columns over all nodes, and the nodes of each depth."""
    n = len(forest.parent)
    parent, depth, end = (np.array(x, np.int64) for x in (forest.parent, forest.depth, forest.end))
    up = np.maximum(parent, 0)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    node = np.fromiter((s[0] for s in forest.segments), np.int64, len(forest.segments))
    size = np.fromiter((len(s[2]) for s in forest.segments), np.float64, len(forest.segments))
    stops = np.fromiter((s[2].count(".") + s[2].count(",") for s in forest.segments), np.float64, len(forest.segments))
    own = np.bincount(node, size, n)
    linked = _down(np.array([t == "a" for t in forest.tag], np.float64), parent, levels, np.maximum)
    chars = _under(own, end)
    links = _under(own * linked, end)
    marks = _under(np.bincount(node, stops, n), end)
    pieces = _under(np.bincount(node[size > 1], minlength=n).astype(np.float64), end)
    tags = _under(np.ones(n), end)
    is_p = np.array([t == "p" for t in forest.tag], np.float64)
    paragraphs = _under(is_p, end)
    controls = _under(np.array([t in CONTROLS for t in forest.tag], np.float64), end)
    items = _under(np.array([t in ("li", "a") for t in forest.tag], np.float64), end)
    page = forest.page_of()
    roots = np.array(forest.roots, np.int64)[page]
    whole = np.maximum(chars[roots], 1)
    upto = np.concatenate([[0], np.cumsum(own)])
    begin = (upto[np.arange(n)] - upto[roots]) / whole
    density = chars / tags
    link_share = links / np.maximum(chars, 1)
    # siblings
    siblings = np.bincount(up, minlength=n)[up].astype(np.float64)
    largest = np.zeros(n)
    np.maximum.at(largest, up, chars)
    first = np.concatenate([[0], np.cumsum(np.ones(n))])[:-1]
    place = (first - first[up]) / np.maximum(tags[up], 1)
    like_p = np.bincount(up, is_p, n)[up] / np.maximum(siblings, 1)
    columns = [
        depth.astype(np.float64), np.log1p(chars), np.log1p(own), np.log1p(tags), density, link_share, np.log1p(paragraphs), marks / np.maximum(chars, 1),
        chars / whole, begin, begin + chars / whole, place, np.log1p(siblings), like_p, chars / np.maximum(largest[up], 1), chars / np.maximum(chars[up], 1),
        density[up], link_share[up], controls / tags, items / tags, chars / np.maximum(pieces, 1),
    ]
    if tag_odds is not None:
        low, high = tag_odds.of([(t,) for t in forest.tag])
        columns += [low + high, _down(low, parent, levels, np.minimum), _down(high, parent, levels, np.maximum)]
        low, high = name_odds.of(forest.names)
        columns += [low, high, _down(low, parent, levels, np.minimum), _down(high, parent, levels, np.maximum)]
    return columns, levels


class BoostedTrees:
    """Logistic boosting of oblivious trees over binned features: all leaves of a level split alike."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.splits: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, columns: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in columns]
        binned = [np.searchsorted(e, c, side="left") for e, c in zip(edges, columns, strict=True)]
        share = float((label * weight).sum() / weight.sum())
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(label), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (label - p), weight * p * (1 - p)
            leaf = np.zeros(len(label), np.int64)
            tree = []
            for _level in range(self.depth):
                k = int(leaf.max()) + 1
                best = (-1.0, 0, 0)
                for f, b in enumerate(binned):
                    width = len(edges[f]) + 1
                    key = leaf * width + b
                    left_g, left_h = (np.cumsum(np.bincount(key, x, k * width).reshape(k, width), axis=1) for x in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = (left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge)).sum(axis=0)[:-1]
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
                _, f, cut = best
                tree.append((f, float(edges[f][cut])))
                leaf = leaf * 2 + (binned[f] > cut)
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            score += value[leaf]
            self.splits.append(tree)
            self.leaves.append(value)
        return self

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log odds."""
        out = np.full(len(columns[0]), self.base)
        for tree, value in zip(self.splits, self.leaves, strict=True):
            leaf = np.zeros(len(out), np.int64)
            for f, edge in tree:
                leaf *= 2
                leaf += columns[f] > edge
            out += value[leaf]
        return out


OUTSIDE, MAIN, LEFT = 0, 1, 2
#: Log chances of entering the main text and of leaving it, at a child.
ENTER, LEAVE = -1.0, -2.0


def decode(odds: np.ndarray, inline: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The best labelling of all trees with outside* main* left* on every way down; inline nodes are as their parents."""
    n = len(odds)
    yes = -np.log1p(np.exp(-np.clip(odds, -6, 6)))
    no = -np.log1p(np.exp(np.clip(odds, -6, 6)))
    value = np.stack([no, yes, no], axis=1)
    value[inline] = 0
    sums = np.zeros((n, 3))
    for level in reversed(levels):
        value[level] += sums[level]
        down = np.stack([np.maximum(value[level, 0], value[level, 1] + ENTER), np.maximum(value[level, 1], value[level, 2] + LEAVE), value[level, 2]], axis=1)
        down[inline[level]] = value[level][inline[level]]
        some = parent[level] >= 0
        np.add.at(sums, parent[level][some], down[some])
    state = np.zeros(n, np.int64)
    state[levels[0]] = value[levels[0], :2].argmax(axis=1)
    for level in levels[1:]:
        above, v = state[parent[level]], value[level]
        enters, leaves = v[:, 1] + ENTER > v[:, 0], v[:, 2] + LEAVE > v[:, 1]
        free = np.where(above == OUTSIDE, np.where(enters, MAIN, OUTSIDE), np.where(above == MAIN, np.where(leaves, LEFT, MAIN), LEFT))
        state[level] = np.where(inline[level], above, free)
    return state


class Extractor:
    """Trained trees and tables of names."""

    def __init__(self, n_pages: int = 900, seed: int = 1):
        forest = Forest()
        for page in pages(n_pages, seed):
            forest.add(page)
        label = np.array(forest.gold)
        parent = np.array(forest.parent)
        inline = np.array([t in INLINE for t in forest.tag])
        for i in np.flatnonzero(inline).tolist():
            label[i] = label[parent[i]]
        self.tag_odds = Odds([(t,) for t in forest.tag], label)
        self.name_odds = Odds(forest.names, label)
        columns, _ = features(forest, self.tag_odds, self.name_odds)
        learn = np.flatnonzero(~inline)
        own = columns[1][learn]
        self.trees = BoostedTrees().fit([c[learn] for c in columns], label[learn], 1.0 + own / own.mean())

    def texts(self, sources: list[str | None]) -> list[str]:
        """The main text of each page."""
        forest = Forest()
        for source in sources:
            forest.add(source or "")
        columns, levels = features(forest, self.tag_odds, self.name_odds)
        inline = np.array([t in INLINE for t in forest.tag], bool)
        parent = np.array(forest.parent, np.int64)
        state = decode(self.trees.score(columns), inline, parent, levels)
        page = forest.page_of()
        out: list[list[str]] = [[] for _ in sources]
        last = -1
        run: list[str] = []
        main = (state == MAIN).tolist()
        pages_ = page.tolist()

        def close(p: int) -> None:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out[p].append(text)
            run.clear()

        at = 0
        for node, block, text in forest.segments:
            if block != last:
                if run:
                    close(at)
                last = block
            if main[node]:
                at = pages_[node]
                run.append(text)
        if run:
            close(at)
        return ["\n\n".join(blocks) for blocks in out]


def extract(pages_table: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages_table.sparkSession
    small_batches(spark, 256)
    held = spark.sparkContext.broadcast(extractor or Extractor())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, "html"):
            if batch.num_rows:
                found = held.value.texts(batch.column("html").to_pylist())
                yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages_table.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
