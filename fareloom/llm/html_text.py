"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that keeps the tree consistent.

A page becomes a flat tree of its elements. Each structural element has features: its tag, depth, text, link and punctuation
density of its subtree, what its class, id and role tokens stood for in training, and how it compares with its siblings. The trees
say how likely an element holds main text. Decoding picks the labels with the highest total likelihood under which everything
below a dropped element is dropped, and a kept element keeps text or a child.

The model is trained at the start of each query, on layouts made by a fixed rule (`layouts`) around text of a bounded sample of
the given pages (`SAMPLE` pages, those with the smallest hash of the url), since real pages carry no labels.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by a line break.
Scripts, styles, form fields and what the head holds never count. Defined results: a null or empty page has no text; a page
without tags is one block; unclosed and stray tags follow the usual rules (a block ends an open paragraph); repeated and null ids
pass through; other columns are not looked at. Nothing recurses, so depth has no limit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.llm.boosting import Trees, fit_trees
from fareloom.llm.common import slices
from fareloom.llm.layouts import labelled_pages

SAMPLE = 300
PAGES = 700

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg canvas audio video map select option button input textarea label math title meta link".split())
RAW = frozenset(("script", "style"))
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# An element of the first kind ends open ones of the second, up to an element of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "body": (("head",), ("html",)),
}
KINDS = ("article", "main", "section", "div", "p", "h", "list", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "figure", "other")
_KIND = {**{k: k for k in KINDS}, **{f"h{n}": "h" for n in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "blockquote": "quote", "pre": "quote", "figcaption": "figure"}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page(HTMLParser):
    """The elements of a page in document order, and its text in order with the block ends."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.home, self.tokens, self.hidden, self.marks = ["root"], [0], [0], [()], [False], [None]
        self.open = [0]
        self.opened: Counter[str] = Counter()
        self.flow: list[tuple[int, str | None]] = []
        self.link = [False]
        self.feed(html)
        self.close()

    def _end(self, depth: int) -> None:
        for node in self.open[depth:]:
            if self.tag[node] not in INLINE:
                self.flow.append((node, None))
                break
        self.opened.subtract(self.tag[node] for node in self.open[depth:])
        del self.open[depth:]

    def _end_open(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(self.opened[name] for name in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in stop:
                return
            if tag in names:
                self._end(depth)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.opened[tag]:
            return
        if tag in ENDS_PARAGRAPH:
            self._end_open(("p",), ("td", "th", "table", "button", "object"))
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        node, up = len(self.tag), self.open[-1]
        named = dict(attrs)
        words = [w.lower() for key in ("class", "id", "role") if named.get(key) for w in _TOKEN.findall(named[key])]
        inline = tag in INLINE
        self.tag.append(tag)
        self.parent.append(up)
        self.home.append(self.home[up] if inline else node)
        self.tokens.append(tuple(words))
        self.hidden.append(self.hidden[up] or tag in UNSEEN)
        self.marks.append(named.get("data-label"))
        self.link.append(self.link[up] or tag == "a")
        if not inline:
            self.flow.append((node, None))
        elif tag == "br":
            self.flow.append((node, " "))
        if tag not in VOID:
            self.open.append(node)
            self.opened[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1) if self.opened[tag] else ():
            if self.tag[self.open[depth]] == tag:
                self._end(depth)
                return

    def handle_data(self, data: str) -> None:
        self.flow.append((self.open[-1], data))

    def text(self, keep: list[bool]) -> str:
        blocks, held = [], []
        for node, data in self.flow:
            if data is not None:
                if not self.hidden[node] and keep[self.home[node]]:
                    held.append(data)
            elif held:
                blocks.append(" ".join("".join(held).split()))
                held = []
        blocks.append(" ".join("".join(held).split()))
        return "\n".join(b for b in blocks if b)


def features(page: Page, odds: dict[str, float]) -> tuple[list[int], np.ndarray]:
    """The structural elements that hold text, and their features."""
    count = len(page.tag)
    sums = np.zeros((count, 7))  # characters, link characters, words, stops, elements, links, paragraphs
    for node, data in page.flow:
        if data is not None and not page.hidden[node]:
            size = len(data)
            sums[node, :4] += (size, size * page.link[node], data.count(" ") + 1, data.count(".") + data.count(",") + data.count("!") + data.count("?"))
    depth, path = [0] * count, [0.0] * count
    score = [0.0] * count
    for n in range(1, count):
        up = page.parent[n]
        depth[n] = depth[up] + 1
        found = [odds.get(w, 0.0) for w in page.tokens[n]]
        score[n] = max(found, key=abs) if found else 0.0
        path[n] = min(path[up], score[n])
    for n in range(count - 1, 0, -1):
        sums[n, 4] += 1
        sums[n, 5] += page.tag[n] == "a"
        sums[n, 6] += page.tag[n] == "p"
        sums[page.parent[n]] += sums[n]
    nodes = [n for n in range(count) if page.home[n] == n and not page.hidden[n] and sums[n, 0]]
    if not nodes:
        return [], np.zeros((0, 0))
    at = np.array(nodes)
    up = np.array([page.home[page.parent[n]] for n in nodes])
    kinds = np.zeros((len(nodes), len(KINDS)))
    kinds[np.arange(len(nodes)), [KINDS.index(_KIND.get(page.tag[n], "other")) for n in nodes]] = 1
    mine, whole, above = sums[at], np.maximum(sums[0], 1), np.maximum(sums[up], 1)
    rank = {n: i for i, n in enumerate(nodes)}
    order = np.zeros(len(nodes))
    siblings: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        row = siblings.setdefault(int(up[i]), [])
        order[i] = len(row)
        row.append(i)
    before, after, fellows = np.zeros((len(nodes), 2)), np.zeros((len(nodes), 2)), np.zeros(len(nodes))
    shape = np.stack([np.log1p(mine[:, 0]), mine[:, 1] / np.maximum(mine[:, 0], 1)], 1)
    for row in siblings.values():
        before[row[1:]] = shape[row[:-1]]
        after[row[:-1]] = shape[row[1:]]
        fellows[row] = len(row)
    parent_kind = np.array([kinds[rank[u]].argmax() if u in rank else -1 for u in up.tolist()])
    columns = [
        np.log1p(mine),
        mine[:, :1] / whole[0],
        mine[:, :1] / above[:, :1],
        mine[:, 1:2] / np.maximum(mine[:, :1], 1),
        mine[:, :1] / np.maximum(mine[:, 4:5], 1),
        mine[:, 3:4] / np.maximum(mine[:, 2:3], 1),
        np.stack([[depth[n] for n in nodes], [score[n] for n in nodes], [path[n] for n in nodes], order, fellows, order / np.maximum(fellows, 1), parent_kind], 1),
        before,
        after,
        kinds,
    ]
    return nodes, np.concatenate(columns, 1)


def decode(page: Page, nodes: list[int], logits: np.ndarray) -> list[bool]:
    """The most likely labels (keep or not, for every element) that agree along each path."""
    gain = dict(zip(nodes, np.clip(logits, -20, 20).tolist(), strict=True))  # of keeping over dropping
    count = len(page.tag)
    below, best_child, own_text = [0.0] * count, [-np.inf] * count, [False] * count
    for node, data in page.flow:
        if data and not page.hidden[node] and not data.isspace():
            own_text[page.home[node]] = True
    worth = [0.0] * count
    for n in range(count - 1, -1, -1):
        if page.home[n] != n or page.hidden[n] or n not in gain and n:
            value = below[n] if page.home[n] != n else -np.inf
        else:
            forced = 0.0 if own_text[n] or best_child[n] >= 0 else best_child[n]
            value = gain.get(n, 0.0) + below[n] + (forced if np.isfinite(forced) else 0.0)
        worth[n] = value
        if n:
            up = page.home[page.parent[n]]
            if page.home[n] == n and np.isfinite(value):
                below[up] += max(0.0, value)
                best_child[up] = max(best_child[up], value)
    keep = [False] * count
    keep[0] = True
    needed: dict[int, int] = {}
    for n in range(1, count):
        if page.home[n] == n and np.isfinite(worth[n]) and n in gain:
            up = page.home[page.parent[n]]
            if worth[n] > (worth[needed[up]] if up in needed else -np.inf):
                needed[up] = n
    for n in range(1, count):
        up = page.home[page.parent[n]]
        if page.home[n] == n and n in gain and keep[up]:
            alone = up != 0 and not own_text[up] and best_child[up] < 0 and needed.get(up) == n
            keep[n] = worth[n] > 0 or alone
    return keep


class Extractor:
    """A trained model: what tokens stood for, and the trees."""

    def __init__(self, odds: dict[str, float], trees: Trees):
        self.odds, self.trees = odds, trees

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [Page(html or "") for html in pages]
        found = [features(p, self.odds) for p in parsed]
        rows = [x for _, x in found if len(x)]
        logits = self.trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for page, (nodes, _) in zip(parsed, found, strict=True):
            out.append(page.text(decode(page, nodes, logits[at : at + len(nodes)])))
            at += len(nodes)
        return out


def _truth(page: Page) -> list[bool]:
    """Per element of a made page: does its subtree hold main text? Marks say where main text and other parts begin."""
    main = [False] * len(page.tag)
    holds = [False] * len(page.tag)
    for n in range(1, len(page.tag)):
        main[n] = page.marks[n] == "main" or page.marks[n] is None and main[page.parent[n]]
    for node, data in page.flow:
        if data and data.strip() and main[node] and not page.hidden[node]:
            holds[node] = True
    for n in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[n]] |= holds[n]
    return holds


def fit(pages: list[str], trees: int = 60) -> Extractor:
    """Train on pages whose elements are marked by `data-label`, main or other."""
    parsed = [Page(p) for p in pages]
    truths = [_truth(p) for p in parsed]
    counts: dict[str, list[int]] = {}
    for page, truth in zip(parsed, truths, strict=True):
        for n in range(1, len(page.tag)):
            for word in set(page.tokens[n]):
                counts.setdefault(word, [0, 0])[truth[n]] += 1
    odds = {w: float(np.log((b + 1) / (a + 1))) for w, (a, b) in counts.items()}
    found = [features(p, odds) for p in parsed]
    x = np.concatenate([f for _, f in found if len(f)])
    y = np.array([truth[n] for (nodes, _), truth in zip(found, truths, strict=True) for n in nodes], float)
    return Extractor(odds, fit_trees(x, y, trees))


def train(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = SAMPLE, made: int = PAGES) -> Extractor:
    """Layouts by rule around text of a bounded sample of the pages."""
    source = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")).where("html IS NOT NULL AND length(html) < 200000")
    chosen = source.select("url", F.xxhash64("url").alias("h")).distinct().orderBy("h", "url").limit(most)
    sample = source.join(F.broadcast(chosen), "url").select("html").limit(2 * most).collect()
    pieces = [b for r in sample for b in Page(r.html).text([True] * (r.html.count("<") + 2)).split("\n")]
    return fit(labelled_pages(pieces, made))


def extract(pages: DataFrame, model: Extractor, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 19):
            texts = model.texts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("url", source.schema["url"].dataType), T.StructField("text", T.StringType())])
    found = source.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
