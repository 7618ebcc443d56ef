"""Toxicity by a classifier chain.

The categories are predicted one after another. Each has a linear model over hashed word and word-stem features, and
takes the probabilities of the categories before it as further inputs; in training these are out-of-fold
predictions, so that a later model meets earlier probabilities as uncertain as they are on unseen text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SLOTS = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
STEMS = (4, 5, 6)


class Slots(dict):
    """Word to the slots of the word and of its stems; remembers up to half a million words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 500_000:
            self.clear()
        parts = [f"w{word[:64]}", *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]
        self[word] = out = tuple(xxhash.xxh64_intdigest(utf8(p)) % SLOTS for p in parts)
        return out


def present(text: str | None, slots: Slots) -> np.ndarray:
    """Sorted slots of the features that the text has."""
    words = {m.group() for m in TOKEN.finditer(text.lower())} if text else ()
    return np.unique(np.fromiter(chain.from_iterable(map(slots.__getitem__, words)), np.int32))


@dataclass
class Link:
    """One category's model: weights by slot, weights of the earlier categories' log odds, bias, threshold."""

    name: str
    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5


def sparse(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of these rows that are among the chosen slots."""
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    at = np.searchsorted(chosen, flat)
    at[at == len(chosen)] = 0
    keep = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
    return where[keep], at[keep]


def fit_link(name: str, rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, most_features: int, rounds: int = 200) -> Link:
    """Features that stand out by chi-square, scaled by their log ratio; ridge logistic regression by momentum steps."""
    n, positive = len(rows), int(y.sum())
    flat = np.concatenate(rows) if n else np.empty(0, np.int32)
    inside = np.concatenate([np.full(len(r), v) for r, v in zip(rows, y, strict=True)]) if n else np.empty(0, bool)
    df, dp = np.bincount(flat, minlength=SLOTS), np.bincount(flat[inside], minlength=SLOTS)
    if positive in (0, n):
        return Link(name, np.empty(0, np.int32), np.empty(0), np.zeros(earlier.shape[1]), -20.0 if not positive else 20.0)
    p, q = (dp + 0.5) / (positive + 1), (df - dp + 0.5) / (n - positive + 1)
    expected = df * positive / n
    chi = np.where(df >= 3, (dp - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[: min(most_features, int((chi > 15).sum()))]).astype(np.int32)
    ratio = np.log(p[chosen] / q[chosen])
    i, j = sparse(rows, chosen)
    x = ratio[j]
    w, c, bias = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), float(np.log(positive / (n - positive)))
    vw, vc, vb, ridge = np.zeros_like(w), np.zeros_like(c), 0.0, 1e-3
    step = 2.0 / (0.25 * max(1e-9, np.bincount(i, x * x, n).max(initial=1.0)) + 0.25 * max(1.0, (earlier**2).sum(1).max(initial=0.0)))
    for _ in range(rounds):
        z = np.bincount(i, x * w[j], n) + earlier @ c + bias
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        vw = 0.9 * vw - step * (np.bincount(j, x * g[i], len(w)) / n * 20 + ridge * w)
        vc = 0.9 * vc - step * (earlier.T @ g / n * 20 + ridge * c)
        vb = 0.9 * vb - step * g.mean() * 20
        w, c, bias = w + vw, c + vc, bias + vb
    return Link(name, chosen, w * ratio, c, bias)


def probabilities(link: Link, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    i, j = sparse(rows, link.slots)
    z = (np.bincount(i, link.weights[j], len(rows)) if len(link.slots) else np.zeros(len(rows))) + earlier @ link.earlier + link.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.5) -> float:
    """Middle of the gap after which the F score of out-of-fold predictions is best; beta over 1 favours recall."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = (1 + beta**2) * hits / (np.arange(1, len(p) + 1) + beta**2 * max(y.sum(), 1))
    k = int(np.argmax(score))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = 3, most_features: int = 20_000) -> list[Link]:
    """A link per category, in the order of `labels`; fold of a row: its place modulo `folds`."""
    n, links, known = len(rows), [], np.empty((len(rows), 0))
    fold = np.arange(n) % folds
    for name, y in labels.items():
        out = np.zeros(n)
        for f in range(folds):
            at, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            part = fit_link(name, [rows[i] for i in rest], y[rest], known[rest], most_features)
            out[at] = probabilities(part, [rows[i] for i in at], known[at])
        link = fit_link(name, rows, y, known, most_features)
        link.threshold = best_threshold(out, y) if 0 < y.sum() < n else 0.5
        links.append(link)
        known = np.column_stack([known, log_odds(out)])
    return links


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, most_rows: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Features and labels of at most most_rows labelled rows, the first by a hash of their ids.

    Of several labels of one id the greatest counts, category by category; a label row with a null is no label. Rows of
    one id and the same features are one, so that a document that is often repeated does not crowd out others.
    """
    wanted = labels.where(" and ".join(f"`{c}` is not null" for c in [id_col, *categories]))
    wanted = wanted.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)))
    wanted = wanted.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ys = [f"y{i}" for i in range(len(categories))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        for batch in batches:
            batch["x"] = [present(t, slots).tobytes() for t in batch.pop("text")]
            yield batch

    # at most most_rows ids of a few integers each
    sample = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", *ys, "text")
    kinds = ", ".join(f"{y} int" for y in ys)
    found = sample.mapInPandas(read, f"doc_id long, {kinds}, x binary").dropDuplicates(["doc_id", "x"])
    got = found.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "x").limit(most_rows).toPandas().sort_values(["doc_id", "x"], kind="stable")
    return [np.frombuffer(x, np.int32) for x in got["x"]], {c: got[f"y{i}"].to_numpy() > 0 for i, c in enumerate(categories)}


def predict_chain(docs: DataFrame, links: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and for each category p_<name> (probability) and is_<name>.

    A null or empty text has no features: the models' biases decide. Every row is judged by its text; an empty
    table gives no rows; other columns are not read.
    """
    # plain values: a broadcast is unpickled where this package need not be installed
    shared = docs.sparkSession.sparkContext.broadcast([(x.name, x.slots, x.weights, x.earlier, x.bias, x.threshold) for x in links])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, chain_ = Slots(), [Link(*x) for x in shared.value]
        for batch in batches:
            rows = [present(t, slots) for t in batch["text"]]
            out, known = {"doc_id": batch["doc_id"].astype("Int64").to_numpy()}, np.empty((len(rows), 0))
            for link in chain_:
                p = probabilities(link, rows, known)
                out |= {f"p_{link.name}": p, f"is_{link.name}": p >= link.threshold}
                known = np.column_stack([known, log_odds(p)])
            yield pd.DataFrame(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"p_{x.name} double, is_{x.name} boolean" for x in links)
    return rows.mapInPandas(run, f"doc_id long, {kinds}")
