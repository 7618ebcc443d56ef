"""Near-dedup joins the components of a large key through their nearest nodes before it makes pairs of all that is left."""

import random
from itertools import combinations

import numpy as np
import pytest

from pulsegrid.llm import set_dedup


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in range(len(sets))}


def copies(n, edits, words=200, name="w", seed=4):
    """Copies of one text with so many edited words each: with two edits each a pair is similar, with three it is not."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text = [f"{name}{j}" for j in range(words)]
        for at in rng.sample(range(words), edits[i % len(edits)]):
            text[at] = f"{name}edit{rng.random()}"
        out.append(" ".join(text))
    return out


def test_pairs_of_a_large_group_grow_with_its_nodes(spark, monkeypatch):
    asked, decide = [], set_dedup.by_sketches
    monkeypatch.setattr(set_dedup, "by_sketches", lambda near, *args: asked.append(near.count()) or decide(near, *args))
    texts = copies(240, (2, 2, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs, rounds=0).collect()}
    assert got == components(texts)
    assert sum(asked) < 30 * len(texts)  # all pairs are 119 for each


@pytest.mark.parametrize("tile, rounds", [(2048, 1), (7, 0)])
def test_nearest_rounds_lose_no_link(spark, monkeypatch, tile, rounds):
    monkeypatch.setattr(set_dedup, "LARGE", 2)
    line = " all rights are reserved by the owners of this page and others"
    texts = [*copies(20, (1, 2, 3, 4)), *copies(15, (3, 4), name="v", seed=5), *copies(12, (0, 5, 8), name="u", seed=6)]
    texts += [f"{' '.join(f's{i}x{j}' for j in range(9))}{line}" for i in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs, tile=tile, rounds=rounds).collect()}
    assert got == components(texts)


def test_nearest_keeps_the_least_apart_of_each_component():
    rng = np.random.default_rng(3)
    n, of = rng.integers(50, 60, 40), rng.integers(0, 9, 40)
    table = rng.integers(0, 9, (40, 64)).astype(np.int16)
    i, j = map(np.array, zip(*[p for p in combinations(range(40), 2) if of[p[0]] != of[p[1]]], strict=True))
    apart = np.abs(table[i] - table[j]).sum(1) / (n[i] + n[j])
    kept = [set(zip(*map(np.ndarray.tolist, x), strict=True)) for x in set_dedup.nearest(iter([(i[:300], j[:300]), (i[300:], j[300:])]), of, n, table, 3)]
    want = set()
    for c in set(of.tolist()):
        at = np.flatnonzero((of[i] == c) | (of[j] == c))
        want |= {(int(i[x]), int(j[x])) for x in at[np.argsort(apart[at], kind="stable")[:3]]}
    assert len(kept) == 1 and kept[0] == want
    assert list(set_dedup.nearest(iter([]), of, n, table, 3)) == []


def test_pairs_within_a_slice_come_from_its_own_tile():
    import pandas as pd

    rows = pd.DataFrame({"h": range(4), "key": 1, "size": 1, "c": range(4), "n": 10, "own": True, "head": True, "slice": [0, 0, 1, 1]})
    rows[list(set_dedup.PIVOTS)] = 0
    made = []
    for low, high in ((0, 0), (0, 1), (1, 1)):
        part = rows[rows["slice"].isin((low, high))].assign(tile=low * set_dedup.SLICES + high)
        for out in set_dedup.pairs_in(0.8)(iter([part])):
            made += list(zip(out["a"], out["b"], strict=True))
    assert sorted(made) == list(combinations(range(4), 2))
