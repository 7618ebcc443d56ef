"""Near-dedup's steps grow with its nodes and links, not with the rounds or with what many texts share."""

import random

from pulsegrid.llm import components, set_dedup


def test_component_rounds_send_each_link_once(spark, monkeypatch):
    plans, write = [], components.Scratch._written
    monkeypatch.setattr(components.Scratch, "_written", lambda self, df, path: plans.append(df._jdf.queryExecution().toString()) or write(self, df, path))
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(30)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert len(plans) > 3 and not any("Generate" in p for p in plans)


def test_rounds_hand_on_components_in_place_of_links(spark, monkeypatch):
    """Copies that are all alike have links in many keys; what a round hands on has a row a node."""
    given, join, prove, found = [], set_dedup.connected_components, set_dedup.verified, []
    monkeypatch.setattr(set_dedup, "connected_components", lambda edges, keep=None: given.append(edges.count()) or join(edges, keep=keep))
    monkeypatch.setattr(set_dedup, "verified", lambda *args: (lambda links: found.append(links.count()) or links)(prove(*args)))
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(400)], []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(400), 5):
            words[at] = f"e{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs, rounds=3).collect()}
    assert got == dict.fromkeys(range(40), 0)
    # the first call has fingerprints, the second fingerprints' links; the others a row a node and the last round's links
    assert len(found) > 2
    for edges, new in zip(given[2:], found[1:], strict=False):
        assert edges <= len(texts) + new


def test_common_shingles_are_those_of_a_share_of_the_rows(spark):
    line = " all rights are reserved by the owners of this page"
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)) + line) for i in range(2000)], "doc_id long, text string")
    keys, rank = set_dedup.common_shingles(docs, 5, 1, 100)
    shared = {int(x) for x in set_dedup.shingle_set(line, 5)}
    assert shared == {int(x) for x in keys} and (rank > 3).all()
    assert list(keys) == sorted(keys)
