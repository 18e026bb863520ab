"""Main text of web pages by a tree-structured graphical model over their DOM."""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm.common import hash_sample, read_table, text_column, text_slices

#: Labelled pages that the model is fitted on at most (a seeded hash sample if there are more).
MAX_LABELLED = 2_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>", re.S | re.I)
_CLUES = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
_OPENS_BLOCK = _BLOCK - {"br", "hr"}
_MARKUP = frozenset(("article", "main"))
_TAGS = ("#text", "html", "head", "title", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "b", "i", "em", "strong", "span", "table", "tr", "td", "br", "form", "button", "pre", "blockquote", "figure", "img")
_TAG_ID = {t: i for i, t in enumerate(_TAGS)}
_WORDS = (("ad", "ads", "advert", "banner", "promo", "sponsor"), ("nav", "menu", "breadcrumb", "sidebar", "related", "share", "social"), ("footer", "copyright", "cookie", "legal", "comment"), ("content", "article", "main", "post", "entry", "body", "text"))
FEATURES = (len(_TAGS) + 1, len(_WORDS) + 1, 8, 6, 5, 8)


class Page:
    """The nodes of a page in document order: element and text nodes, each after its parent."""

    __slots__ = ("parent", "depth", "tag", "clue", "length", "linked", "marked", "texts", "block")

    def __init__(self):
        self.parent, self.depth, self.tag, self.clue, self.length, self.linked, self.marked = [], [], [], [], [], [], []
        self.texts: dict[int, str] = {}
        self.block: list[int] = []


def _clue(attrs: str) -> int:
    for m in _CLUES.finditer(attrs):
        names = set(re.split(r"[^a-z]+", m.group(1).lower()))
        for i, words in enumerate(_WORDS):
            if names & set(words):
                return i + 1
    return 0


def parse(source: str) -> Page:
    """Builds the tree of a page; tags that are left open or closed twice are mended as browsers would, roughly."""
    page = Page()
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    links, marks, block, blank = 0, 0, 0, False

    def add(tag: int, clue: int, length: int) -> int:
        up = stack[-1][1] if stack else -1
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.tag.append(tag)
        page.clue.append(clue)
        page.length.append(length)
        page.linked.append(length if links else 0)
        page.marked.append(marks > 0)
        page.block.append(block)
        return len(page.parent) - 1

    def pop() -> None:
        nonlocal links, marks, block
        name = stack.pop()[0]
        opened[name] -= 1
        links -= name == "a"
        marks -= name in _MARKUP
        block += name in _BLOCK

    def text(raw: str) -> None:
        nonlocal blank
        if raw and not raw.isspace():
            page.texts[add(0, 0, len(raw.strip()))] = " " + raw if blank else raw
            blank = False
        else:
            blank = blank or bool(raw)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if m.group(2):
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        closes = _CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _OPENS_BLOCK:
                    break
        block += name in _BLOCK
        node = add(_TAG_ID.get(name, len(_TAGS)), _clue(m.group(4)) if "=" in m.group(4) else 0, 0)
        if name not in _VOID and not m.group(4).endswith("/"):
            stack.append((name, node))
            opened[name] += 1
            links += name == "a"
            marks += name in _MARKUP
    text(source[at:])
    return page


class Forest:
    """The nodes of many pages as arrays, with what a node's whole subtree holds, and the nodes by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.ends[:-1], sizes)
        flat = lambda name: np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, int(self.ends[-1]))
        parent, self.depth = flat("parent"), flat("depth")
        self.parent = np.where(parent >= 0, parent + shift, -1)
        self.tag, clue, self.length, linked, self.marked = flat("tag"), flat("clue"), flat("length"), flat("linked"), flat("marked")
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(int(self.depth.max(initial=-1)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        whole, whole_linked = self.length.copy(), linked.copy()
        kids = np.zeros(len(parent), np.int64)
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            np.add.at(whole, up, whole[level])
            np.add.at(whole_linked, up, whole_linked[level])
            np.add.at(kids, up, 1)
        share = np.where(whole > 0, whole_linked * 4 // np.maximum(whole, 1), 0)
        up_tag = np.where(self.parent >= 0, self.tag[self.parent], len(_TAGS))
        self.features = np.stack([self.tag, clue, np.minimum(7, np.log2(whole + 1) // 1.5).astype(np.int64), np.minimum(5, np.log2(kids + 1)).astype(np.int64), share, np.minimum(7, _GROUP[up_tag])], axis=1)


def _groups() -> np.ndarray:
    kind = {"nav": 0, "ul": 0, "ol": 0, "li": 0, "a": 0, "footer": 1, "header": 1, "aside": 1, "article": 2, "main": 2, "section": 3, "div": 4, "p": 5, "h1": 6, "h2": 6, "h3": 6}
    return np.array([*(kind.get(t, 7) for t in _TAGS), 7])


_GROUP = _groups()


class TreeModel:
    """Potentials of nodes and of parent-child pairs, and sum-product message passing over whole forests."""

    def __init__(self, root: np.ndarray, pair: np.ndarray, node: list[np.ndarray]):
        self.root, self.pair, self.node = root, pair, node

    @classmethod
    def fit(cls, forest: Forest, labels: np.ndarray) -> TreeModel:
        """Maximum likelihood from labelled trees, with one added to every count."""
        root = 1.0 + np.bincount(labels[forest.parent < 0], minlength=2)
        kid = forest.parent >= 0
        pair = 1.0 + np.bincount(labels[forest.parent[kid]] * 2 + labels[kid], minlength=4).reshape(2, 2)
        node = []
        for f, n in enumerate(FEATURES):
            counts = 1.0 + np.bincount(labels * n + forest.features[:, f], minlength=2 * n).reshape(2, n)
            node.append(np.log(counts / counts.sum(1, keepdims=True)))
        return cls(np.log(root / root.sum()), np.log(pair / pair.sum(1, keepdims=True)), node)

    def marginals(self, forest: Forest) -> np.ndarray:
        """The chance that each node is content, given all nodes of its page: messages to the root, then to the leaves."""
        own = sum(table[:, forest.features[:, f]].T for f, table in enumerate(self.node))
        own = own.reshape(-1, 2)
        below = own.copy()
        sent = np.zeros_like(below)
        for level in reversed(forest.levels[1:]):
            sent[level] = np.logaddexp(self.pair[:, 0] + below[level, :1], self.pair[:, 1] + below[level, 1:])
            np.add.at(below, forest.parent[level], sent[level])
        above = np.zeros_like(below)
        for k, level in enumerate(forest.levels):
            if not k:
                above[level] = self.root
                continue
            up = forest.parent[level]
            rest = above[up] + below[up] - sent[level]
            above[level] = np.logaddexp(rest[:, :1] + self.pair[0], rest[:, 1:] + self.pair[1])
            above[level] -= above[level].max(1, keepdims=True)
        total = above + below
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700)))


def page_text(page: Page, content: np.ndarray) -> str:
    """The text of the page's content nodes: one line a block, white space folded, entities resolved."""
    lines: list[list[str]] = []
    last, blank = None, False
    for node, raw in page.texts.items():
        if content[node]:
            if page.block[node] != last:
                lines.append([])
                last = page.block[node]
            lines[-1].append(" " + raw if blank else raw)
            blank = False
        else:
            blank = blank or raw[0].isspace() or raw[-1].isspace()
    joined = (" ".join(htmllib.unescape("".join(x)).split()) for x in lines)
    return "\n".join(x for x in joined if x)


def train(pages: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED) -> TreeModel:
    """Fits the model to pages that label their own content: those that mark it as article or main."""
    marked = pages.select(pages[html_col].alias("h")).filter(F.col("h").rlike("(?i)<(article|main)\\b"))
    key = F.xxhash64(F.lit(3), F.col("h"))
    rows = hash_sample(marked, key, max_labelled).orderBy(key, "h").limit(max_labelled).collect()
    parsed = [p for p in (parse(r["h"]) for r in rows) if p.parent]
    forest = Forest(parsed)
    labels = forest.marked.astype(np.int64)
    return TreeModel.fit(forest, labels)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = MAX_LABELLED, model: TreeModel | None = None) -> DataFrame:
    """Rows (page_id, text, n_nodes, n_content): each page's main text, and how many nodes it has and how many are content.

    A node is content if its marginal chance is a half or more. A null page gives a null text and no nodes, an empty one an
    empty text. Pages without markup are one text node each; pages of any length or depth are read whole, in time that grows
    with their length. Repeated rows get the same result, and nothing is ordered, so there are no ties. Without labelled
    pages the model knows nothing and takes every text node. An empty table gives no rows. Other columns, whatever their
    names, are left out.
    """
    model = model or train(pages, html_col, max_labelled)
    tables = pages.sparkSession.sparkContext.broadcast(model)
    src = pages.select(pages[id_col].alias("k"), pages[html_col].alias("h"))

    def run(batches):
        m = tables.value
        for batch in batches:
            for part in text_slices(batch, "h", 4_000_000):
                raw = text_column(part, "h")
                parsed = [parse(h or "") for h in raw]
                forest = Forest(parsed)
                content = m.marginals(forest) >= 0.5
                spans = list(zip(forest.ends.tolist(), forest.ends[1:].tolist()))
                texts = [None if h is None else page_text(p, content[a:b]) for h, p, (a, b) in zip(raw, parsed, spans)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([b - a for a, b in spans], pa.int32()), pa.array([int(content[a:b].sum()) for a, b in spans], pa.int32())], ["k", "text", "n_nodes", "n_content"]
                )

    out = src.mapInArrow(run, T.StructType([T.StructField("k", src.schema["k"].dataType), T.StructField("text", T.StringType()), T.StructField("n_nodes", T.IntegerType()), T.StructField("n_content", T.IntegerType())]))
    return out.withColumnRenamed("k", id_col)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
