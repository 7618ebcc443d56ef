"""Exact near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from pulsegrid.llm import set_dedup


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.random()}"
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if similar(sets[i], sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


def planted():
    """Copies with scattered and bunched edits, similarities mostly of 0.7 to 0.95, and lines that all share."""
    rng = random.Random(5)
    line, texts = "all rights are reserved by the owners of this page and others", []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        texts.append(" ".join(base) + " " + line)
        for _ in range(5):
            texts.append(" ".join(edited(base, rng, rng.randrange(1, max(3, len(base) // 35)))) + " " + line)
        cut = rng.randrange(len(base) // 6)
        texts.append(" ".join(base[cut:]))
    exact = [f"x{i}" for i in range(94)]  # 90 shingles; without the last 18 words 72 of them, 0.8 just so
    return [*texts, " ".join(exact), " ".join(exact[:-18]), " ".join(exact[:-19]), None, "", " \n", "one", "one", "ONE", "a b", "a b c"]


@pytest.mark.parametrize("tile, rounds, sample", [(2048, 2, 20_000), (3, 0, 20_000), (4, 1, 1)])
def test_near_copies_match_brute_force(spark, tile, rounds, sample):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs, tile=tile, rounds=rounds, sample=sample).collect()}
    assert [got[i] for i in range(len(texts))] == components([shingles(t) for t in texts])


def test_prefixes_meet():
    rng = random.Random(6)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        pool = rng.sample(range(10**9), 2 * n)
        a = pool[:n]
        b = a[: rng.randrange(n + 1)] + pool[n : n + rng.randrange(max(n // 4, 1) + 1)]
        if not b or not similar(set(a), set(b)):
            continue
        common = np.array(sorted(rng.sample(a, n // 2)), np.uint64)
        for order in (none, (common, np.array([rng.randrange(1, 9) for _ in common], np.int64))):
            x, y = (set(set_dedup.prefix(np.unique(np.array(s, np.uint64)), 0.8, *order).tolist()) for s in (a, b))
            assert x & y


def test_the_first_shared_shingle_is_in_the_smaller_head():
    rng = random.Random(8)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        pool = rng.sample(range(10**9), 2 * n)
        a = pool[:n]
        b = a[: rng.randrange(n + 1)] + pool[n : n + rng.randrange(max(n // 4, 1) + 1)]
        if not b or not similar(set(a), set(b)):
            continue
        both = min(set(a) & set(b))
        for one, other in ((a, b), (b, a)):
            if len(one) <= len(other):
                assert both in sorted(one)[: set_dedup.head_length(len(one), 0.8)]


def test_near_copies_edges(spark):
    assert set_dedup.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    rows = set_dedup.near_copies(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3)]


def test_the_stage_decides_by_exact_similarity(spark):
    """Pairs near 0.8, on either side: fingerprint bits get some of them wrong."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    texts = []
    for i in range(40):
        base = [f"w{rng.randrange(9000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(base, rng, 3 + i % 4))]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stays = {r.doc_id for r in pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert stays == {i for i, c in enumerate(components([shingles(t) for t in texts])) if i == c}
