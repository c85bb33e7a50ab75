"""Operator 2: the main text of web pages, by a tree-structured graphical model.

The block elements of a page and the runs of text in them are the nodes of a tree of binary variables: content or not. A node's
own potential is linear in features of its tag, its class and id words and its text; an edge's depends on
what the child is. Messages go from the leaves up and from the root down (sum-product), which gives each run's marginal
exactly. The weights maximise the likelihood of labelled pages; its gradient needs the same messages.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

# Fixed values, from the HTML standard.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head noscript template svg math object canvas select button audio video datalist applet".split())
#: A start tag that ends an open element of its own kind, and what that search doesn't pass.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",))}
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>]+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
PERHAPS_HIDDEN = re.compile(r"hidden|display", re.I)


def is_hidden(attributes: str) -> bool:
    """Whether a start tag says so by ``hidden``, ``aria-hidden`` or its style; names and values are told apart."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and INVISIBLE.search(value):
            return True
    return False


@dataclass
class Node:
    parent: int
    tag: str
    names: tuple[str, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def parse(page: str | None) -> list[Node]:
    """Block elements and, as leaves of tag ``#text``, runs of text between them, in page order. Node 0 is the page.

    Open elements that the standard ends by another's start are ended; a run goes through inline elements; a tag that the page's end cuts is dropped.
    """
    nodes = [Node(-1, "#page")]
    stack: list[tuple[str, int]] = []  # open elements; of inline ones -1
    at, run, links, skip = 0, -1, 0, 0
    page = page or ""
    raw = ""

    def close(k: int) -> None:
        nonlocal at, run, links, skip
        while len(stack) > k:
            tag, node = stack.pop()
            if node >= 0:
                at, run = nodes[node].parent, -1
            elif node == -2:
                skip -= 1
            elif tag == "a":
                links -= 1

    def data(text: str) -> None:
        nonlocal run
        if not text or skip:
            return
        if run < 0:
            if text.isspace():
                return
            nodes.append(Node(at, "#text"))
            run = len(nodes) - 1
        text = charrefs.unescape(text)
        nodes[run].parts.append(text)
        if links > 0:
            nodes[run].linked += len(text)

    pos = 0
    for m in TOKEN.finditer(page):
        if m.start() < pos:
            continue
        data(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] == "" and m.end() == len(page) and not page.endswith(">"):
            break
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0 and (tag in BLOCKS or tag in HIDDEN or not any(n >= 0 for _, n in stack[k + 1 :])):
                close(k)
            elif k >= 0:  # an inline element that a block crosses
                if stack[k] == ("a", -1):
                    links -= 1
                if stack[k][1] == -1:
                    del stack[k]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in VOID and tag != "hr":
            data(" ")
            continue
        if tag in BLOCKS:
            p = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("p", "td", "th", "table", "button")), -1)
            if p >= 0 and stack[p][0] == "p":
                close(p)
            if tag in CLOSES:
                own, stop = CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in own:
                        close(k)
                        break
                    if stack[k][0] in stop:
                        break
            run = -1
            if tag == "hr":
                continue
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in HIDDEN or PERHAPS_HIDDEN.search(m[3]) and is_hidden(m[3]):
            stack.append((tag, -2))
            skip += 1
        elif tag in BLOCKS and tag not in ("html", "body"):
            words = tuple(w.lower() for n in NAMES.finditer(m[3]) for w in NAME_WORD.findall(n[1] or n[2] or n[3] or ""))
            nodes.append(Node(at, tag, words))
            at = len(nodes) - 1
            stack.append((tag, at))
        elif tag not in ("html", "body"):
            stack.append((tag, -1))
            links += tag == "a"
    else:
        data(page[pos:])
    return nodes


# ---- the model


def _features(nodes: list[Node]) -> list[list[str]]:
    """Names of a node's features, all with value 1; amounts come as classes."""
    out = []
    chars = [0] * len(nodes)
    linked = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        chars[i] += sum(map(len, nodes[i].parts))
        linked[i] += nodes[i].linked
        if nodes[i].parent >= 0:
            chars[nodes[i].parent] += chars[i]
            linked[nodes[i].parent] += linked[i]
    for i, x in enumerate(nodes):
        own = ["bias:" + ("text" if x.tag == "#text" else "block"), "tag:" + x.tag, *{"name:" + w for w in x.names}]
        if x.tag == "#text":
            text = "".join(x.parts)
            words = len(text.split())
            own += [f"in:{nodes[x.parent].tag}", f"words:{min(7, words.bit_length())}", f"stops:{min(3, sum(map(text.count, '.!?,')))}"]
            own += [f"@{nodes[x.parent].tag}:words:{min(5, words.bit_length())}"]
        own.append(f"links:{min(4, 5 * linked[i] // max(1, chars[i]))}")
        out.append(own)
    return out


@dataclass
class Forest:
    """The trees of some pages. level: distance from the root; kind: 1 for a run of text; of and what: the features of nodes, as pairs."""

    parent: np.ndarray
    level: np.ndarray
    kind: np.ndarray
    of: np.ndarray
    what: np.ndarray

    @staticmethod
    def of_pages(pages: list[list[Node]], index: dict[str, int], grow: bool = False) -> Forest:
        parent, level, kind, of, what = [], [], [], [], []
        for nodes in pages:
            base = len(parent)
            for i, (x, own) in enumerate(zip(nodes, _features(nodes), strict=True)):
                parent.append(base + x.parent if x.parent >= 0 else -1)
                level.append(level[base + x.parent] + 1 if x.parent >= 0 else 0)
                kind.append(int(x.tag == "#text"))
                for f in own:
                    k = index.setdefault(f, len(index)) if grow else index.get(f, -1)
                    if k >= 0:
                        of.append(base + i)
                        what.append(k)
        return Forest(*(np.array(a, np.int64) for a in (parent, level, kind, of, what)))


def marginals(forest: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on trees, all pages' levels side by side.

    own: each node's log potential of being content. edge[kind, parent state, child state]: log potentials.
    Returns each node's probability of content, and of each (parent state, child state) of its edge.
    """
    n = len(own)
    belief = np.stack([np.zeros(n), own], axis=1)
    up = np.zeros((n, 2))
    order = np.argsort(forest.level, kind="stable")
    cuts = np.searchsorted(forest.level[order], np.arange(forest.level.max() + 2)) if n else np.zeros(1, np.int64)
    levels = [order[cuts[k] : cuts[k + 1]] for k in range(len(cuts) - 1)]
    for own_level in reversed(levels[1:]):
        up[own_level] = np.logaddexp.reduce(belief[own_level][:, None, :] + edge[forest.kind[own_level]], axis=2)
        np.add.at(belief, forest.parent[own_level], up[own_level])
    joint = np.zeros((n, 2, 2))
    down = np.zeros((n, 2))
    for k, own_level in enumerate(levels):
        if k:
            p = forest.parent[own_level]
            rest = belief[p] + down[p] - up[own_level]
            both = rest[:, :, None] + edge[forest.kind[own_level]] + belief[own_level][:, None, :]
            down[own_level] = np.logaddexp.reduce(rest[:, :, None] + edge[forest.kind[own_level]], axis=1)
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[own_level] = both / both.sum(axis=(1, 2), keepdims=True)
    total = belief + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


@dataclass
class PageModel:
    index: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [parse(h) for h in htmls]
        forest = Forest.of_pages(pages, self.index)
        own = np.bincount(forest.of, weights=self.weights[forest.what], minlength=len(forest.parent))
        p, _ = marginals(forest, own, self.edge)
        out, base = [], 0
        for nodes in pages:
            blocks = (" ".join("".join(x.parts).split()) for i, x in enumerate(nodes) if x.tag == "#text" and p[base + i] >= 0.5)
            out.append("\n\n".join(b for b in blocks if b))
            base += len(nodes)
        return out


def fit(pages: list[tuple[str, set[str]]], *, rounds: int = 300, rate: float = 0.1, l2: float = 0.2) -> PageModel:
    """Adam on the log likelihood of labelled pages: (html, the texts of its content runs). A block is content if more than half of the text in it is."""
    index: dict[str, int] = {}
    trees = [parse(h) for h, _ in pages]
    forest = Forest.of_pages(trees, index, grow=True)
    label: list[int] = []
    for nodes, (_, content) in zip(trees, pages, strict=True):
        good, size = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if x.tag == "#text":
                text = " ".join("".join(x.parts).split())
                size[i], good[i] = len(text), len(text) * (text in content)
            if x.parent >= 0:
                good[x.parent] += good[i]
                size[x.parent] += size[i]
        label += [int(2 * g > n) for g, n in zip(good, size, strict=True)]
    y = np.array(label, float)
    n = len(y)
    w, edge = np.zeros(len(index)), np.zeros((2, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    m, v = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, rounds + 1):
        own = np.bincount(forest.of, weights=w[forest.what], minlength=n)
        p, joint = marginals(forest, own, edge)
        g = [np.bincount(forest.what, weights=(p - y)[forest.of], minlength=len(index)) + l2 * w, np.stack([joint[child][forest.kind[child] == k].sum(axis=0) for k in (0, 1)]) - seen + l2 * edge]
        for k, x in enumerate((w, edge)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return PageModel(index, w, edge)


@cache
def default_model() -> PageModel:
    from .labelled_pages import labelled_pages

    return fit(labelled_pages())


def extract(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """Returns page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    The text is the content blocks in page order, white space within each made one blank, joined by two line feeds. A null or
    empty page and one without content have the text ''. Nothing of a page is passed over for its length.
    Repeated rows and null ids stay, other columns are ignored, no rows give no rows. Without a ``model``, the one learned from labelled_pages().
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            htmls = htmls.where(htmls.notna(), "").tolist()
            out = []
            for block in pieces(("x" * min(len(h), 1 << 20) for h in htmls), 1 << 20):
                out += shared.value.texts([htmls[i] for i, _ in block])
            yield pd.Series(out, dtype=object)

    out = pages.select("page_id", "url", of("html").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
