"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints are joined to one node first. Two fingerprints at distance k or less, cut into r blocks of
bits, agree on at least r - k blocks: each choice of r - k blocks is a key, and only nodes that share a key meet.
Inside a key the pivot table holds each node's Hamming distances to reference fingerprints; by the triangle
inequality, a pair whose largest coordinate difference is over k is discarded unverified, and the rest are verified
by their own Hamming distance. r follows the number of distinct fingerprints, so that keys stay selective; any r
finds the same links. A key with very many nodes is cut into tiles, each of which returns only a spanning forest of
its links: components need no more, and no group is emitted as pairs or held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder, utf8
from .components import connected_components

#: Reference fingerprints: fixed values of a splitmix sequence, 32 ones or so each.
PIVOTS = 16


#: Names of the four fingerprints by which links may be verified.
VERIFY = ("v0", "v1", "v2", "v3")


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words joined by a space; of all words if they are fewer."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-shingle]).tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the text's word shingles; 0 for no words."""
    words = utf8(text).lower().split()
    return majority(shingle_hashes(words, shingle)) if words else 0


def verifiers(text: str | None, shingle: int) -> tuple[int, ...]:
    """Four further fingerprints, of other bits of mixed hashes of the distinct shingles: 256 bits to estimate their cosine by."""
    words = utf8(text).lower().split()
    if not words:
        return (0,) * len(VERIFY)
    hashes, out = np.unique(shingle_hashes(words, shingle)), []
    for i in range(len(VERIFY)):
        mixed = (hashes ^ np.uint64(0xA0761D6478BD642F * (i + 1) % 2**64)) * np.uint64(0xE7037ED1A0B428DB)
        out.append(majority(mixed ^ (mixed >> np.uint64(32))))
    return tuple(out)


def fingerprints(docs: DataFrame, shingle: int, verify_shingle: int | None, id_col: str, text_col: str) -> DataFrame:
    names = VERIFY if verify_shingle else ()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(t, shingle) for t in batch["text"]]})
            if names:
                out[list(names)] = np.array([verifiers(t, verify_shingle) for t in batch["text"]], np.int64).reshape(-1, len(names))
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *names)))


def block_masks(blocks: int, same: int) -> list[int]:
    """Masks of every choice of `same` out of `blocks` runs of bits, as signed longs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(runs, same)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def blocks_for(nodes: int, distance: int) -> int:
    """Fewest blocks by which a key of all nodes has two nodes or fewer, at 40 keys a node or fewer; at least distance + 1."""
    best = distance + 1
    for r in range(distance + 1, 17):
        if math.comb(r, distance) > max(40, math.comb(distance + 2, 2)):
            break
        best = r
        if 64 * (r - distance) // r >= math.log2(max(nodes, 2)) + 4:
            break
    return best


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    z = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    refs = z ^ (z >> np.uint64(31))
    return np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int8)


def close(i: np.ndarray, j: np.ndarray, fps: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those whose pivot coordinates all differ by k or less and that are verified to be within k."""
    for coordinates in table:
        keep = np.abs(coordinates[i] - coordinates[j]) <= k
        i, j = i[keep], j[keep]
        if len(i) < 1024:
            break
    keep = np.abs(table[:, i] - table[:, j]).max(0, initial=0) <= k
    i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= k
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to each node's least reachable place, in place of the links i-j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def links_of_group(group: np.ndarray, fps: np.ndarray, k: int, more: np.ndarray | None = None, most: int = 0, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of the same group; rows are sorted by group.

    more: a column of verifying fingerprints per row, of which a link may differ in `most` bits in all.
    """
    table, n = pivot_table(fps), len(fps)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])).max(initial=1)
    rows, step, held = np.arange(n), 1, 0
    while step < size:
        rows = rows[rows + step < n]
        rows = rows[group[rows] == group[rows + step]]
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            pair = close(part, part + step, fps, table, k)
            if more is not None and len(pair[0]):
                keep = np.bitwise_count(more[pair[0]] ^ more[pair[1]]).sum(1) <= most
                pair = pair[0][keep], pair[1][keep]
            if len(pair[0]):
                found.append(pair)
                held += len(pair[0])
        if held > 4 * n + 100_000:
            found, held = [forest(n, *map(np.concatenate, zip(*found, strict=True)))], n
        step += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(n, *map(np.concatenate, zip(*found, strict=True)))


def links_in(k: int, names: tuple[str, ...], most: int):
    """mapInPandas over rows sorted by group: forests of links, group by group, whatever the batches."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["t", "key", "tile"]].to_numpy()
        group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(1))]
        node = rows["node"].to_numpy()
        i, j = links_of_group(group, rows["fp"].to_numpy().view(np.uint64), k, np.ascontiguousarray(rows[list(names)].to_numpy()).view(np.uint64) if names else None, most)
        return pd.DataFrame({"a": node[i], "b": node[j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[["t", "key", "tile"]].to_numpy()
            ended = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(ended[-1]) + 1 if len(ended) else 0
            if rest and (rest[-1][["t", "key", "tile"]].iloc[-1].to_numpy() != keys[-1]).any() and not cut:
                yield link(pd.concat(rest))
                rest = []
            if cut:
                yield link(pd.concat([*rest, batch.iloc[:cut]]))
                rest = []
            rest.append(batch.iloc[cut:])
        if rest:
            yield link(pd.concat(rest))

    return run


def fingerprint_links(nodes: DataFrame, distance: int, names: tuple[str, ...] = (), most: int = 0, tile: int = 4096) -> DataFrame:
    """Forests (a, b) of the links of `distance` or fewer bits between nodes (fp, node, and `names` to verify by): block
    keys bring pairs together, the pivot table discards, distances decide."""
    blocks = blocks_for(nodes.count(), distance)
    masks = block_masks(blocks, blocks - distance)
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))).alias("k")
    keyed = nodes.select("fp", *names, "node", keys).select("fp", *names, "node", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").count().where("count > 1")
    met = keyed.join(shared, ["t", "key"])
    # a key with more nodes than a tile holds: every pair of its slices is a tile of its own
    slices = F.ceil(F.col("count") / tile).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(8)), F.col("slices"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda s: F.least(s, F.col("own")) * 2_000_000_000 + F.greatest(s, F.col("own")))
    met = met.withColumn("slices", slices).withColumn("own", F.when(F.col("slices") > 1, own).otherwise(0))
    met = met.select("t", "key", "fp", *names, "node", F.explode(F.when(F.col("slices") > 1, tiles).otherwise(F.array(F.lit(0).cast("long")))).alias("tile"))
    sorted_groups = met.repartition(partitions(nodes.sparkSession), "t", "key", "tile").sortWithinPartitions("t", "key", "tile", "fp")
    return sorted_groups.mapInPandas(links_in(distance, names, most), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", verify: tuple[int, float] | None = None, tile: int = 4096) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id that links of `distance` or fewer bits reach.

    verify=(n, similarity) keeps only links whose distinct n-word shingles have about that Jaccard similarity or
    more, as estimated from 256 further fingerprint bits (standard error some 0.04).

    Null and empty texts have fingerprint 0 and link like any other. A row with a null id links like any other too: it
    can be the bridge between two others. It is returned with its component's least id, or null if no row of the
    component has one. Repeated rows are returned as often as they come; an empty table gives no rows; other columns
    are not read. Ids are integers, or strings of digits.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    names = VERIFY if verify else ()
    # bits of 64 * len(VERIFY) that differ at this similarity: the angle between sets of one size
    most = round(64 * len(VERIFY) * math.acos(2 * verify[1] / (1 + verify[1])) / math.pi) if verify else 0
    prints = fingerprints(docs, shingle, verify[0] if verify else None, id_col, text_col).checkpoint()
    # nodes are named by their fingerprints, so that those without an id have names as well
    node = F.xxhash64("fp", *names) if names else F.col("fp")
    nodes = prints.groupBy("fp", *names).agg(F.min("doc_id").alias("least")).withColumn("node", node)
    edges = fingerprint_links(nodes, distance, names, most, tile)
    named = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", *names, "component_id")
    return prints.join(named, ["fp", *names], "left").select("doc_id", "fp", "component_id")
