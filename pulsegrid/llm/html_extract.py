"""HTML main text by minimum cut.

A page is read into blocks of text in page order. A linear classifier gives each block a cost of being called content
or boilerplate: the capacities of its edges to source and sink. What the markup says (an article, a menu, a class named
comments) is two of its features among others. Neighbours in the page are joined by smoothness edges that fall off with
their distance in the DOM, and so are the blocks under one parent. The minimum cut labels all blocks of the page at
once; the blocks on the source's side are the main text.

The classifier is trained here, on blocks whose own markup says what they are, with that hint hidden from half of them,
so that text, tags and place must speak for themselves. The strength of the edges is the one of STRENGTHS by which the
cut gets the least text wrong on the same pages with all hints hidden.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, utf8

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")  # of a tag, behind its name
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "iframe")}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTENT = frozenset("article main content post entry story articlebody maincontent".split())
BOILERPLATE = frozenset(
    "nav navbar navigation menu header footer aside sidebar ad ads advert adverts advertisement sponsored banner promo cookie cookies consent notice notices alert form search login signup subscribe newsletter comment comments respond reply replies share social related breadcrumb breadcrumbs toolbar widget popup modal copyright pagination pager toc skip".split()
)
TAG_HINTS = frozenset(("article", "main", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button"))
SKIPPED = frozenset(("noscript", "template", "select", "svg", "object"))  # their text goes when their own end tag comes
ITEMS = frozenset("li dt dd td th option".split())
WORD = re.compile(r"[a-z]+")

STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0)  # of the edge between neighbours that are siblings
DECAY = 0.25  # of an edge for each further step between two blocks in the DOM
BESIDE = 0.5  # share of that edge for the block before under the same parent, next to it in the page or not
ACROSS = 0.25  # share of an edge that is left where hints differ
SURE = 0.95  # how often a hint is taken to be right
FEATURES = ("bias", "length", "linked", "sentence", "short", "punctuation", "heading", "sign", "place", "paragraph", "item", "company", "said_content", "said_boilerplate")
#: Where the fit starts from, and what it is without pages to learn from.
START = np.array([-1.0, 0.5, -2.0, 1.0, -0.5, 1.0, 0.5, -1.0, 0.0, 0.5, -0.5, 1.0, 2.5, -4.5])
#: Ridge of each weight, per row: what the markup says holds on pages of other makes than those learned from.
RIDGE = np.array([0.002] * 12 + [0.2] * 2)


def tag_ends(page: str) -> Callable[[int], int]:
    """Where the tag that goes on from a position ends, or -1: its first > outside quotes. All answers are made in one walk
    from the page's end, over its quotes and >: behind a closed quote a tag goes on as another does from there."""
    marks = [m.start() for m in re.finditer("[>\"']", page)]
    ends, later = [-1] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        c = page[marks[i]]
        if c == ">":
            ends[i] = marks[i]
        else:
            ends[i] = ends[later[c] + 1] if c in later else -1
            later[c] = i
    return lambda at: ends[bisect_left(marks, at)]


def pieces(page: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(text, "", False, "") or (None, tag in lower case, whether it ends, attributes), in order; comments, declarations and
    raw elements are passed over, a < that begins nothing is text. In time proportional to the page, however it is broken: only
    a tag that does not end is looked through in vain, and from the first of them on `tag_ends` answers."""
    at, n, ends, no_more = 0, len(page), None, False
    while at < n:
        if page[at] != "<":
            to = page.find("<", at)
            to = to if to >= 0 else n
            yield page[at:to], "", False, ""
            at = to
            continue
        if page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            if to < 0:
                return
            at = to + 3
            continue
        m = NAME.match(page, at + 1)
        if m:
            if ends is None:
                rest = REST.match(page, m.end())
                stop = rest.end() - 1 if rest else -1
                ends = None if rest else tag_ends(page)
            else:
                stop = ends(m.end())
            if stop >= 0:
                tag, after = m[2].lower(), page[m.end()]
                at = stop + 1
                if not m[1] and tag in RAW and (after in "/>" or after.isspace()):
                    end = RAW[tag].search(page, at)
                    to = page.find(">", end.end()) if end else -1
                    if to < 0:
                        return
                    at = to + 1
                else:
                    yield None, tag, bool(m[1]), page[m.end() : stop]
                continue
        if not no_more and page[at + 1 : at + 2] in ("!", "?", "/"):
            to = page.find(">", at + 2)
            no_more = to < 0
            if to >= 0:
                at = to + 1
                continue
        yield "<", "", False, ""
        at += 1


def hint_of(tag: str, attributes: str, inside: int) -> int:
    """+1 content, -1 boilerplate, else what holds outside. A header or footer inside content says nothing."""
    if tag in ("header", "footer") and inside > 0:
        return inside
    if tag in ("article", "main"):
        return 1
    if tag in TAG_HINTS:
        return -1
    if attributes:
        names = {w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
        if names & BOILERPLATE:
            return -1
        if names & CONTENT:
            return 1
    return inside


def blocks_of(page: str | None) -> list[tuple[str, int, int, int, bool, str, int]]:
    """(text, hint, parent, characters in links, is a heading, tag, steps) of every block with text, in page order.

    steps is the length of the way through the DOM from the block before.
    """
    out: list[tuple[str, int, int, int, bool, str, int]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, hint, number
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    marks: dict[int, tuple[int, int]] = {}  # number of an open element whose text is skipped: blocks and link before it
    number, texts, linked, in_link, in_head, own = 0, [], 0, 0, False, (0, 0, False, "", 1)
    depth, low = 1, 1  # of the block before; the least since

    def close() -> None:
        nonlocal texts, linked, depth, low
        text = " ".join("".join(texts).split())
        if text:
            low = min(low, own[4])
            out.append((text, own[0], own[1], min(linked, len(text)), own[2], own[3], depth + own[4] - 2 * low))
            depth = low = own[4]
        texts, linked = [], 0

    for text, tag, ends, attributes in pieces(page or ""):
        if text is not None:
            if not in_head:
                if not texts:
                    top = stack[-1]
                    own = (stack[-1][1], stack[-2][2] if len(stack) > 1 else 0, top[0] in ("h1", "h2", "h3", "h4", "h5", "h6"), top[0], len(stack))
                text = html.unescape(text)
                texts.append(text)
                linked += len(text) * (in_link > 0)
            continue
        if tag in ("head", "title"):
            in_head = not ends
            continue
        if tag in ("body", "article", "main", "div", "p", "nav"):
            in_head = False
        if tag in VOID:
            if tag in ("br", "hr"):
                texts.append(" ") if texts else None
            continue
        if tag == "a":
            in_link = 0 if ends else 1
        if tag in INLINE:
            continue
        close()
        if ends:
            at = places[tag][-1] if places.get(tag) else len(stack)
            if at < len(stack) and tag in SKIPPED:
                before, in_link = marks[stack[at][2]]
                del out[before:]
            while len(stack) > at:
                places[stack.pop()[0]].pop()
            low = min(low, len(stack))
        else:
            skipped = tag in SKIPPED
            if (stack[-1][0] == "p" and not skipped) or (tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                places[stack.pop()[0]].pop()
                low = min(low, len(stack))
            if tag == "svg" and attributes.endswith("/"):
                continue
            number += 1
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, hint_of(tag, attributes, stack[-1][1]), number))
            if skipped:
                marks[number] = len(out), in_link
            in_link = in_link if skipped else 0
    close()
    return out


def features(blocks: list, shown: np.ndarray | None = None) -> np.ndarray:
    """A row per block, in the order of FEATURES; shown says which blocks' hints may be seen (all, if it is not given)."""
    rows, under = [], {}
    for text, _, parent, *_ in blocks:
        under[parent] = under.get(parent, 0) + len(text)
    whole = sum(under.values())
    for i, (text, hint, parent, linked, heading, tag, _) in enumerate(blocks):
        words = text.split()
        hint = hint if shown is None or shown[i] else 0
        place = abs(2 * i + 1 - len(blocks)) / len(blocks)
        punctuation = sum(w[-1] in ",;.:" for w in words) / len(words)
        rows.append((1.0, math.log1p(len(text)) / 4, linked / len(text), text[-1] in ".!?…", len(words) < 5, punctuation, heading, "©" in text or "|" in text, place, tag == "p", tag in ITEMS, under[parent] / whole, hint > 0, hint < 0))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression with a ridge towards START by Newton steps, each class with the same total weight."""
    w = START.copy()
    if not len(rows) or labels.min() == labels.max():
        return w
    share = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum()) * len(labels)
    target = np.where(labels, SURE, 1 - SURE)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (share * (p - target)) + len(rows) * RIDGE * (w - START)
        hessian = (rows * (share * p * (1 - p))[:, None]).T @ rows + len(rows) * np.diag(RIDGE)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def smoothness(blocks: list, strength: float) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) of neighbours in the page and of neighbours under one parent."""
    edges, last = [], {}
    for j, (_, hint, parent, _, _, _, steps) in enumerate(blocks):
        for i, weight in ((j - 1, DECAY ** max(steps - 2, 0)), (last.get(parent, -1), BESIDE)):
            if i >= 0 and weight > 1e-4:
                edges.append((i, j, strength * weight * (ACROSS if blocks[i][1] != hint else 1.0)))
        last[parent] = j
    return edges


def source_side(costs: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut by Dinic's algorithm: nodes with positive cost are tied to the source, negative to the sink."""
    n = len(costs)
    if (costs > 0).all() or (costs <= 0).all():
        return (costs > 0).tolist()
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs.tolist()):
        edge(s, i, c, 0.0) if c > 0 else edge(i, t, -c, 0.0)
    for a, b, weight in edges:
        edge(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue and level[t] < 0:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, a = [0] * (n + 2), [], s
        while True:  # blocking flow, by an explicit path
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def labelled(blocks: list, weights: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each block is content: by the classifier alone, and by the minimum cut."""
    costs = np.clip(features(blocks) @ weights, -6, 6)
    return costs > 0, np.array(source_side(costs, smoothness(blocks, strength)), bool)


def main_text(page: str | None, weights: np.ndarray, strength: float) -> tuple[str, int, int]:
    """The text, the number of blocks, and of those that the cut labels otherwise than the classifier alone."""
    blocks = blocks_of(page)
    if not blocks:
        return "", 0, 0
    alone, content = labelled(blocks, weights, strength)
    return " ".join(b[0] for b, c in zip(blocks, content, strict=True) if c), len(blocks), int((alone != content).sum())


def unhinted(blocks: list) -> list:
    return [(b[0], 0, *b[2:]) for b in blocks]


def fit(pages: DataFrame, html_col: str, most_pages: int, most_blocks: int = 100_000) -> tuple[np.ndarray, float]:
    """The classifier's weights and the edges' strength, from about most_pages different pages, chosen by a hash.

    Blocks in elements with a hint are labelled by it, at most most_blocks of them, chosen by a hash.
    """
    spark = pages.sparkSession
    shared_folder(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                blocks = blocks_of(page)
                if blocks:
                    order = np.array([xxhash.xxh64_intdigest(utf8(f"{i} {b[0]}")) >> 1 for i, b in enumerate(blocks)], np.int64)
                    rows = features(blocks, order % 2 > 0)
                    yield pd.DataFrame([(b[1] > 0, list(r), o) for b, r, o in zip(blocks, rows, order, strict=True) if b[1]], columns=["y", "x", "o"])

    rows = pages.select(F.col(html_col).alias("html")).where("html is not null").withColumn("h", F.xxhash64("html", F.lit(9)))
    share = most_pages / max(rows.agg(F.approx_count_distinct("h")).first()[0], most_pages)
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates(["h"]).select("html").checkpoint()
    got = sample.mapInPandas(read, "y boolean, x array<double>, o long").orderBy("o", "y", "x").limit(most_blocks).collect()
    weights = train(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], bool))

    def wrong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                blocks = blocks_of(page)
                truth, size = np.array([b[1] for b in blocks]), np.array([len(b[0]) for b in blocks])
                if blocks:
                    hidden = unhinted(blocks)
                    lost = [int(size[(truth != 0) & (labelled(hidden, weights, s)[1] != (truth > 0))].sum()) for s in STRENGTHS]
                    yield pd.DataFrame({"strength": STRENGTHS, "wrong": lost})

    tried = sample.mapInPandas(wrong, "strength double, wrong long").groupBy("strength").agg(F.sum("wrong").alias("wrong")).collect()
    return weights, min(tried, key=lambda r: (r.wrong, abs(math.log(r.strength)))).strength if tried else 1.0


def extract(pages: DataFrame, model: tuple[np.ndarray, float], id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the columns in `keep`, text and n_chars of every page; n_blocks, and n_moved, those that the cut decided
    against the classifier alone.

    A null or empty page, or one that is all boilerplate, has an empty text. Every row is read by itself, however often
    it comes; a block whose cost is 0 and that no edge decides is boilerplate; an empty table gives no rows; columns
    other than those named are not read. Work and memory grow with the page's length.
    """
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h, *model) for h in batch.pop("html")]
            batch[["text", "n_blocks", "n_moved"]] = pd.DataFrame(found, columns=["text", "n_blocks", "n_moved"], index=batch.index)
            yield batch

    rows = pages.select(F.col(id_col).alias("page_id"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(html_col).alias("html"))
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.drop("html").dtypes)
    out = rows.mapInPandas(run, f"{kinds}, text string, n_blocks long, n_moved long")
    return out.select("page_id", *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_moved")
