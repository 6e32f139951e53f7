"""HTML main text by minimum-cut labelling.

A page is cut into blocks (runs of text between tags of block elements). A logistic classifier
over each block's words, links, kind and names gives its costs: the log odds become a
capacity to the content terminal or to the boilerplate terminal. Blocks next to each other and
siblings in one container are tied by smoothness edges, the stronger the closer they are in the
tree. Article and main elements are no feature: they are ties among the blocks in them, and none lead out of
them. So short or odd blocks go with the container that they are in, whatever it is called. The minimum cut splits the blocks; those on the content side are the main text.

The classifier starts from the stated prior weights and is fitted on at most ``SAMPLE_PAGES``
pages (those of the smallest hashes), with the semantic elements of their markup as labels; only block features reach the driver.

Defined results: null or empty html, and pages without content, give an empty text; unclosed
and stray tags are tolerated (an unclosed script, style, title or textarea takes the rest of the page, as in a browser); text outside any element counts as a block; repeated rows get the
same text; columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, STEPS, RATE, PULL = 1500, 150, 0.5, 0.02
#: Smoothness of neighbours in page order, of those in one container, and per shared level of the tree.
NEXT, SIBLING, LEVEL = 0.5, 2.0, 0.05
#: Ties from one block of an article or main element to its next one that no name calls boilerplate.
ARTICLE = 4.0

# Elements of the HTML standard, whose content is no markup; whose content is not shown.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_UNSEEN = {"head", "template", "datalist"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "select", "summary", "template", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag that ends an open paragraph or list item.
_ENDS_P = _BLOCK - {"button", "caption", "legend", "option", "summary", "head", "html", "body"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
# Words of class names and ids.
_BAD = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login register nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side widget "
    "footer foot header masthead topbar toolbar share sharing social follow related recommended recommendations more trending popular tags comment comments "
    "reply replies respond disqus discussion feedback review reviews form search copyright legal disclaimer hidden skip sr".split()
)
_GOOD = set("article content main post entry story body text page blog news single prose".split())
_READERS = {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion"}
_BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header", "select"}

FEATURES = (
    "bias", "in a boilerplate element", "boilerplate words", "content words", "link share", "log words", "few words",
    "sentence marks", "paragraph", "heading", "list item", "in reader comments",
)
#: Prior weights, in the order of FEATURES.
PRIOR = np.array([-0.5, -6.0, -6.0, 1.0, -4.0, 1.4, -0.4, 1.2, 1.6, 0.6, -0.3, -6.0])


class Frame:
    """An open element: what its blocks inherit."""

    __slots__ = ("tag", "good", "article", "bad_tag", "bad", "nice", "readers", "hidden", "key", "depth", "parent")

    def __init__(self, tag: str, attrs: str, parent: Frame | None, key: int) -> None:
        self.tag, self.parent, self.key = tag, parent, key
        self.depth = parent.depth + 1 if parent else 0
        self.good = parent.good if parent else False
        self.article = parent.article if parent else 0
        self.bad_tag = parent.bad_tag if parent else False
        self.bad = parent.bad if parent else 0
        self.nice = parent.nice if parent else 0
        self.readers = parent.readers if parent else False
        self.hidden = parent.hidden if parent else False
        if tag in ("article", "main"):
            self.good, self.article = True, key
        elif tag in _BAD_TAGS and not (tag == "header" and self.good):
            self.bad_tag = True
        if tag in _UNSEEN:
            self.hidden = True
        if attrs and "=" in attrs or "hidden" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True
                elif name in ("class", "id", "role") and tag not in ("html", "body"):
                    words = {w.lower() for w in _WORD.findall(value)}
                    self.bad += bool(words & _BAD)
                    self.nice += bool(words & _GOOD)
                    self.readers |= bool(words & _READERS)


@dataclass
class Block:
    text: str
    frame: Frame
    linked: int
    tag: str


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with references decoded and white space collapsed."""
    out: list[Block] = []
    root = Frame("", "", None, 0)
    stack, text, linked, in_link, at, serial = [root], [], 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            t = _SPACE.sub(" ", "".join(text)).strip()
            top = stack[-1]
            if t and not top.hidden:
                out.append(Block(t, top, min(linked, len(t)), top.tag))
            text.clear()
        linked = 0

    def add(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            t = page[a:b]
            if "&" in t:
                t = _html.unescape(t)
            text.append(t)
            if in_link:
                linked += len(t)

    m = _TAG.search(page)
    while m:
        add(at, m.start())
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            pass
        elif m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in _BLOCK:
                close()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
        elif tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in _BLOCK:
            close()
            in_link = 0
            if tag in _ENDS_P:
                while len(stack) > 1 and (stack[-1].tag == "p" or tag == "li" and stack[-1].tag == "li"):
                    stack.pop()
            if tag == "body" and stack[-1].tag == "head":
                stack.pop()
            if tag not in ("option", "optgroup", "hr") and any(f.tag == "select" for f in stack[-3:]):
                while stack.pop().tag != "select":  # it was not closed: nothing else stands in one
                    pass
            if tag not in _VOID:
                serial += 1
                stack.append(Frame(tag, m[3], stack[-1], serial))
        m = _TAG.search(page, at)
    add(at, len(page))
    close()
    return out


def block_features(found: list[Block]) -> np.ndarray:
    rows = []
    for b in found:
        f, n = b.frame, b.text.count(" ") + 1
        marks = sum(map(b.text.count, ".!?;,"))
        rows.append((
            1.0, f.bad_tag, min(2, f.bad), min(2, f.nice), b.linked / len(b.text), min(6.0, np.log1p(n)) / 2, n < 4, min(1.0, marks / n * 5),
            b.tag in ("p", "blockquote", "pre"), b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "option", "td", "th"), f.readers,
        ))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def _ties(a: Frame, b: Frame) -> float:
    """Shared levels of the tree, as a share of the deeper one's."""
    deep = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        else:
            break
    return a.depth / max(1, deep)


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    within: dict[int, int] = {}
    for i, b in enumerate(found):
        home = b.frame.parent.key if b.frame.parent else -1
        if i:
            before = found[i - 1].frame
            if before.article == b.frame.article:
                edges[i - 1, i] = NEXT * _ties(before, b.frame) + LEVEL
        j = last.get(home)
        if j is not None and found[j].frame.article == b.frame.article:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING
        last[home] = i
        f = b.frame
        if f.article and not (f.bad_tag or f.bad or f.readers):
            j = within.get(f.article)
            if j is not None:
                edges[j, i] = edges.get((j, i), 0.0) + ARTICLE
            within[f.article] = i
    return edges


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Blocks on the content side of the minimum cut, by shortest augmenting paths.

    Block i has capacity odds[i] from the content terminal if positive, else -odds[i] to the
    boilerplate terminal; an edge can be cut in either direction for its weight.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    supply = [max(0.0, o) for o in odds]
    demand = [max(0.0, -o) for o in odds]
    eps = 1e-9
    while True:
        came = {i: -1 for i in range(n) if supply[i] > eps}
        queue, goal = list(came), -1
        for i in queue:
            if demand[i] > eps:
                goal = i
                break
            for j, c in near[i].items():
                if c > eps and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal < 0:
            return [i in came for i in range(n)]
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(supply[path[-1]], demand[goal], *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
        supply[path[-1]] -= flow
        demand[goal] -= flow
        for a, b in zip(path, path[1:], strict=False):
            near[b][a] -= flow
            near[a][b] += flow


def extract(page: str | None, weights: np.ndarray) -> str:
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    odds = np.clip(block_features(found) @ weights, -20, 20).tolist()
    if min(odds) >= 0 or max(odds) <= 0:  # all on one side: nothing to cut
        keep = [o > 0 for o in odds]
    else:
        keep = min_cut(odds, smoothness(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights pulled from the prior towards what the semantic elements of a sample of pages say.

    A block in an article or main element and in no boilerplate element is content, one in
    neither an article nor main is not. What says so is no feature, so the weights hold for other pages as well.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch["html"]:
                found = blocks(page)
                if any(b.frame.good for b in found):
                    out += [
                        (x.tobytes(), int(b.frame.good and not (b.frame.bad_tag or b.frame.bad)))
                        for b, x in zip(found, block_features(found), strict=True)
                    ]
            yield pd.DataFrame(out, columns=["x", "y"])

    # Only hashes are ordered; then the pages of the smallest ones are read.
    h = F.xxhash64("page_id", "html")
    first = pages.where("html is not null").select(h.alias("__h")).distinct().orderBy("__h").limit(sample)
    chosen = pages.where("html is not null").withColumn("__h", h).join(F.broadcast(first), "__h", "left_semi").select("html")
    got = chosen.mapInPandas(gather, "x binary, y int").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").toPandas()
    w = PRIOR.copy()
    if not len(got):
        return w
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), -1)
    y, n = got["y"].to_numpy(np.float64), got["n"].to_numpy(np.float64)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= RATE * (x.T @ ((p - y) * n) / n.sum() + PULL * (w - PRIOR))
    return w


def main_text(page: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, weights) for p in batch], dtype="object")

    return run(page)
