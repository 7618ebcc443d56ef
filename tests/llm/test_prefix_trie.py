"""The prefix trie against one built node by node."""

import hashlib
import random
import zlib

import pytest

from pulsegrid.llm import prefix_trie as pt
from pulsegrid.llm.common import Scratch

ROW = "conv_id long, turn long, role string, text string, depth string, owner string, size string, stretch string"


def rows(spark, turns):
    """Rows with columns whose names clash with names inside."""
    return spark.createDataFrame([(*t, "a", "b", "c", "d") for t in turns], ROW)


def ordered(turns):
    out = {}
    for c, turn, role, text in turns:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def forks(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """Each node by its sequence of turns."""
    nodes, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
    sums = {}
    for node in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(node, ())]
        own = (len(nodes[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        sums[node] = (sum(b[0] for b in below) if below else 1, own + sum(b[1] for b in below))
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), len(kids.get(node, ())), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def tree(rng, n):
    """Conversations that leave earlier ones at any depth, so that chains hang on chains on chains."""
    out = {}
    for c in rng.sample(range(-50, 1000), n):
        start = rng.choice([*out.values(), []])
        out[c] = start[: rng.randrange(len(start) + 1)] + [(rng.choice("ua"), rng.choice(["x", "yé", "z" * 9])) for _ in range(rng.randrange(1, 7))]
    return out


@pytest.mark.parametrize(("stretch", "seed"), [(1024, 1), (1, 2), (3, 3)])
def test_matches_a_tree_built_node_by_node(spark, monkeypatch, stretch, seed):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    convs = tree(random.Random(seed), 60)
    turns = [(c, k, *t) for c, v in convs.items() for k, t in enumerate(v)]
    random.Random(seed).shuffle(turns)
    assert got(pt.conversation_trie(rows(spark, turns))) == brute(convs)


def test_staircase(spark, monkeypatch):
    """Each conversation leaves the one before at its last turn: a tree of chains as high as it has chains."""
    monkeypatch.setattr(pt, "STRETCH", 4)
    convs = {c: [("u", str(k)) for k in range(c)] + [("a", f"end {c}"), ("a", "more")] for c in range(1, 25)}
    convs |= {c + 100: [("u", str(k)) for k in range(c)] for c in range(5, 12)} | {200: convs[7], 201: convs[7]}
    assert got(pt.conversation_trie(rows(spark, [(c, k, *t) for c, v in convs.items() for k, t in enumerate(v)]))) == brute(convs)


@pytest.mark.parametrize("stretch", [1024, 2])
def test_forks_nulls_ties_and_repeats(spark, monkeypatch, stretch):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    rng = random.Random(5)
    turns = [(rng.randrange(60), rng.choice([None, *range(9)]), rng.choice([None, "", "u", "a"]), rng.choice([None, "", "x", "é", "long " * 50])) for _ in range(400)]
    turns += [(None, 1, "u", "nobody's"), (97, 0, "u", "base is not there"), (3, 4, "u", "x"), (3, 4, "u", "x")]
    with Scratch(spark) as keep:
        assert got(pt.prefix_trie(*pt.forked(rows(spark, turns), keep))) == brute(forks(ordered(turns)))
    assert any(not v for v in forks(ordered(turns)).values()), "some conversation should have no turns"


def test_one_hot_conversation_and_one_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(pt, "STRETCH", 8)
    convs = {0: [("u", str(k)) for k in range(150)]} | {c: [("u", "0"), ("a", "same")] for c in range(1, 60)}
    assert got(pt.conversation_trie(rows(spark, [(c, k, *t) for c, v in convs.items() for k, t in enumerate(v)]))) == brute(convs)


def test_empty_and_turnless(spark):
    assert pt.conversation_trie(rows(spark, [])).count() == 0
    members = spark.createDataFrame([(4, 0), (9, 0)], "conv_id long, length long")
    turns = spark.createDataFrame([], "conv_id long, depth long, mark binary, size long")
    assert got(pt.prefix_trie(turns, members)) == brute({4: [], 9: []})
