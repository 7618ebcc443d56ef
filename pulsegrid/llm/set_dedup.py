"""Near-duplicates by the exact Jaccard similarity of word shingles.

Equal shingle sets are joined to one node first. Their SimHash fingerprints are linked by block keys, pivot table and
Hamming check (simhash_dedup.py), and the sets of each component are compared with one of them. No distance of 64 bits
reaches every similar pair; shared keys find the rest. All sets hold their shingles in one order, common ones last; two
sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each (prefix filter), so that nodes
that share such a key are all the candidates there are, whatever the order. The first shingle that they share is even
among the first n - ceil(2 t / (1 + t) n) + 1 of the smaller set, its head, as at least 2 t / (1 + t) n follow from there:
keys that are in no node's head are dropped, and nodes of a key meet by classes of sizes. Keys are 48 bits of a hash; where they collide, sets decide. In each key every node is first compared
with one other, in rounds while these settle keys. In larger keys that are left, each component is then compared with its
nearest in the pivot table, in rounds while these find links, so that a node is not paired with all of a component that it
belongs to. Only keys whose nodes are still in several components give all their pairs; keys of very many nodes are cut
into tiles. The pivot table holds each set's numbers of shingles in fixed classes, the distances to
references in the metric of symmetric differences: by the triangle inequality a pair whose coordinates are too far
apart cannot be similar and is discarded unverified; what is left meets a larger table, of classes in
proportion to the set. All others are decided by their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, utf8
from .components import connected_components
from .simhash_dedup import fingerprint_links, majority, shingle_hashes

#: The pivot table's columns: numbers of shingles in eight classes each, a byte for each class.
PIVOTS = tuple(f"p{i}" for i in range(8))
SLICE = 256  # texts whose sets a task holds at a time
SLICES = 10_000_000  # a key has fewer
MOST_BROADCAST = 1_000_000  # ids; beyond it a shuffle join
WORTH_A_ROUND = 0.9  # of the rows left by the round before
LARGE = 32  # nodes of a key; components of larger ones are first joined through their nearest
NEAREST, MOST_NEAREST = 4, 16  # pairs of a component in the first such round, and in later ones
MOST_MEMBERS = 512  # sets that one task compares with a hub's set; a hub of more has several tasks


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles in ascending order; empty for no words."""
    words = utf8(text).lower().split()
    return np.unique(shingle_hashes(words, shingle)) if words else np.empty(0, np.uint64)


def set_hash(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), 5)], np.uint64).view(np.int64)[0])


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def head_length(n: int, similarity: float) -> int:
    """So many of the first hashes hold the first one that is shared with a similar set of the same size or more."""
    return n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1 if n else 0


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes in the order of (rank, hash): rank 0 but for the hashes in `common`, which are ascending."""
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, rank[at], 0)))]
    return hashes[: prefix_length(len(hashes), similarity)]


def common_shingles(rows: DataFrame, shingle: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about `sample` texts share, or of a twentieth of the rows if they are more, ascending, and
    their ranks by number. They only set the order. A fixed share of the rows finds what so many rows share in any table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            sets = {set_hash(s): s for s in (shingle_set(t, shingle) for t in batch["text"].unique())}
            yield pd.DataFrame({"key": np.concatenate([np.empty(0, np.uint64), *(s for h, s in sets.items() if h not in seen)]).view(np.int64)})
            seen |= sets.keys()

    n = rows.count()
    share = max(sample, n / 20) / max(n, sample, 1)
    some = rows.select("text").where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = some.mapInPandas(read, "key long").groupBy("key").count().where("count > 3")
    got = counts.orderBy(F.desc("count"), "key").limit(most).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["count"].to_numpy()[order]


def pivots(hashes: np.ndarray) -> np.ndarray:
    """Numbers of hashes in 64 classes, 255 at most, as eight signed longs."""
    return np.bincount((hashes % np.uint64(64)).astype(np.int64), minlength=64).clip(max=255).astype(np.uint8).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The set's row of a larger pivot table: numbers of hashes, 255 at most, in half as many classes as it has hashes or more."""
    classes = 1 << max(6, (len(hashes) - 1).bit_length() - 1)
    counts = np.bincount(((hashes >> np.uint64(16)) % np.uint64(classes)).astype(np.int64), minlength=classes)
    return zstandard.ZstdCompressor(level=1).compress(counts.clip(max=255).astype(np.uint8).tobytes())


def sketch_distance(a: bytes, b: bytes) -> int:
    """The symmetric difference of two sets or less: by the classes of the smaller table, to which the larger folds."""
    x, y = (np.frombuffer(zstandard.ZstdDecompressor().decompress(s), np.uint8).astype(np.int32) for s in (a, b))
    m = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, m).sum(0) - y.reshape(-1, m).sum(0)).sum())


def prints_of(rows: DataFrame, shingle: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """By Arrow, a few texts at a time: a task holds neither a batch's texts nor its sets as Python objects. Equal sets of a
    task give their prefix once, with the first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sets = [shingle_set(t.as_py(), shingle) for t in batch["text"]]
            names, keys = [set_hash(s) for s in sets], []
            for h, s, known in zip(names, sets, batch["doc_id"].is_valid().to_pylist(), strict=True):
                keys.append((prefix(s, similarity, common, rank) >> np.uint64(16)).view(np.int64) if known and h not in seen else np.empty(0, np.int64))
                if known:
                    seen.add(h)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            columns = {"doc_id": batch["doc_id"], "h": pa.array(names, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())}
            columns["fp"] = pa.array([majority(s) if len(s) else 0 for s in sets], pa.int64())
            columns["head"] = pa.array([head_length(len(s), similarity) for s in sets], pa.int64())
            columns["prefix"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            columns["sketch"] = pa.array([sketch(s) for s in sets], pa.binary())
            table = np.array([pivots(s) for s in sets], np.int64).reshape(-1, len(PIVOTS))
            columns |= {p: pa.array(table[:, i]) for i, p in enumerate(PIVOTS)}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, "doc_id long, h long, n long, fp long, head long, prefix array<long>, sketch binary, " + ", ".join(f"{p} long" for p in PIVOTS))


def packed_set(hashes: np.ndarray) -> bytes:
    """Ascending hashes cut to their upper 48 bits, as differences in byte planes: some five bytes each."""
    steps = np.diff(hashes >> np.uint64(16), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def unpacked_set(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def sets_of(rows: DataFrame, shingle: int) -> DataFrame:
    """(hub, part, h, hashes) of rows (hub, part, h, text) whose text has the set h; a text's rows come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, own, blob = None, None, b""
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            keep, blobs = [], []
            for h, now in zip(batch["h"].to_pylist(), batch["text"], strict=True):
                now = now.as_py()
                if own is None or now != text:
                    hashes = shingle_set(now, shingle)
                    text, own, blob = now, set_hash(hashes), packed_set(hashes)
                keep.append(own == h)
                blobs.append(blob)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["hub"], batch["part"], batch["h"], pa.array(blobs, pa.binary())], ["hub", "part", "h", "hashes"]).filter(mask)

    return rows.mapInArrow(run, "hub long, part long, h long, hashes binary")


def table_of(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    return np.ascontiguousarray(rows[names].to_numpy(np.int64)).view(np.uint8).astype(np.int16)


def within(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and rows of the pivot table leave open that two sets are similar."""
    sizes = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-6
    return sizes & (np.abs(a - b).sum(1) <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-6)


def pairs_of_group(group: np.ndarray, component: np.ndarray, n: np.ndarray, own: np.ndarray, head: np.ndarray, table: np.ndarray, similarity: float, part: np.ndarray | None = None, block: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the same group and of different components that size and pivots do not rule out, one of them at least of
    the group's own class of sizes, with the key in the smaller set's head (in both, if they are equal in size), and of
    different parts, if there are parts; rows are sorted by group."""
    size = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])).max(initial=1)
    rows = np.arange(len(group))
    for step in range(1, size):
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        for at in range(0, len(rows), block):
            i = rows[at : at + block]
            j = i + step
            keep = (component[i] != component[j]) & (own[i] | own[j]) & (head[i] | (n[i] > n[j])) & (head[j] | (n[j] > n[i])) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
            keep &= part is None or part[i] != part[j]
            i, j = i[keep], j[keep]
            keep = within(n[i], n[j], table[i], table[j], similarity)
            if keep.any():
                yield i[keep], j[keep]


def nearest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], of: np.ndarray, n: np.ndarray, table: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs of rows, the `most` of each component `of` whose pivots are the least apart for their sizes; not many more are held."""
    held: list[tuple[np.ndarray, ...]] = []

    def best() -> tuple[np.ndarray, ...]:
        i, j, apart = map(np.concatenate, zip(*held, strict=True))
        ends, keep = np.r_[of[i], of[j]], np.zeros(len(i), bool)
        order = np.lexsort((np.r_[apart, apart], ends))
        first = np.flatnonzero(np.r_[True, ends[order][1:] != ends[order][:-1]])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep[order[place < most] % len(i)] = True
        return i[keep], j[keep], apart[keep]

    for i, j in pairs:
        held.append((i, j, np.abs(table[i] - table[j]).sum(1) / (n[i] + n[j])))
        if sum(len(x[0]) for x in held) > 2 * most * len(of) + 200_000:
            held = [best()]
    if held:
        yield best()[:2]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys, in frames that end where a group ends."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if rest and (rest[-1][keys].iloc[-1] != batch[keys].iloc[0]).any():
            yield pd.concat(rest)
            rest = []
        ended = np.flatnonzero((batch[keys].to_numpy() != batch[keys].iloc[-1].to_numpy()).any(1))
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if cut:
            yield pd.concat([*rest, batch.iloc[:cut]])
            rest = []
        rest.append(batch.iloc[cut:])
    if rest:
        yield pd.concat(rest)


def pairs_in(similarity: float, most: int | None = None):
    """mapInPandas over rows sorted by group: all its pairs, or `most` of each component of a group. Where two slices meet,
    the pairs within one of them are left to its own tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["key", "size", "tile"]):
            keys = rows[["key", "size", "tile"]].to_numpy()
            group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(1))]
            h, n, table, tile = rows["h"].to_numpy(), rows["n"].to_numpy(), table_of(rows, list(PIVOTS)), rows["tile"].to_numpy()
            part = np.where(tile // SLICES != tile % SLICES, rows["slice"].to_numpy(), -1 - np.arange(len(rows)))
            pairs = pairs_of_group(group, rows["c"].to_numpy(), n, rows["own"].to_numpy(bool), rows["head"].to_numpy(bool), table, similarity, part)
            if most:
                pairs = nearest(pairs, np.unique(np.c_[group, rows["c"].to_numpy()], axis=0, return_inverse=True)[1].ravel(), n, table, most)
            for i, j in pairs:
                yield pd.DataFrame({"a": np.minimum(h[i], h[j]), "b": np.maximum(h[i], h[j]), "both": n[i] + n[j]})

    return run


def _end(nodes: DataFrame, c: str, names: tuple[str, ...]) -> DataFrame:
    """Columns of the nodes as those of the pairs' end c."""
    return nodes.select(F.col("h").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in names))


def by_pivots(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and pivots do not rule out, with `both`, the sum of their sizes."""
    # the table's bytes as SQL functions: one stage of a task with Python workers, not two
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    apart = reduce(add, (F.abs(byte(F.col(f"{p}_a"), i) - byte(F.col(f"{p}_b"), i)) for p in PIVOTS for i in range(8)))
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    near = sizes & (apart <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)
    met = pairs.join(_end(nodes, "a", ("n", *PIVOTS)), "a").join(_end(nodes, "b", ("n", *PIVOTS)), "b")
    return met.where(near).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"))


def by_sketches(near: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of (a, b, both) that the larger tables do not rule out; near should be written down."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = (1 - similarity) / (1 + similarity)
        for batch in batches:
            keep = [sketch_distance(a, b) <= share * n + 1e-6 for a, b, n in zip(batch["sketch_a"], batch["sketch_b"], batch["both"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    # the larger tables of these pairs' nodes only
    met = near.select(F.col("a").alias("h")).union(near.select("b")).distinct()
    few = F.broadcast if met.count() <= MOST_BROADCAST else (lambda x: x)
    tables = nodes.select("h", "sketch").join(few(met), "h", "left_semi")
    return near.join(_end(tables, "a", ("sketch",)), "a").join(_end(tables, "b", ("sketch",)), "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float, keep: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity or more; pairs should be written down.

    The sets of the b, read from the texts, are sent to their a, each as often as it has pairs and only packed. The b
    of an a with many are dealt to several parts, each of which gets a copy of the set of a.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MOST_MEMBERS).alias("parts"))
    met = pairs.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b", F.lit(3)), F.col("parts")).alias("part"), F.col("b").alias("h"))
    own = parts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("h"))
    wanted = keep(met.union(own).join(nodes.select("h", F.col("node").alias("doc_id")), "h"))
    few = F.broadcast if wanted.count() <= MOST_BROADCAST else (lambda x: x)
    sets = sets_of(rows.join(few(wanted), "doc_id").select("hub", "part", "h", "text"), shingle)
    hubs = sets.where("h = hub").groupBy("hub", "part").agg(F.max("hashes").alias("own"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for to, ours, theirs in zip(batch["hub"], batch["own"], batch["hashes"], strict=True):  # without copies of the sets
                if to.as_py() != last:
                    last, own = to.as_py(), unpacked_set(ours.as_buffer())
                other = unpacked_set(theirs.as_buffer())
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both / (len(own) + len(other) - both) >= similarity)
            yield batch.select(["hub", "h"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # so many tasks that none of them holds many sets, however small the whole is
    tasks = partitions(rows.sparkSession)
    members = sets.where("h <> hub").repartition(tasks, "hub", "part")
    return members.join(hubs.repartition(tasks, "hub", "part"), ["hub", "part"]).mapInArrow(similar, "a long, b long").distinct()


def shared_keys(prints: DataFrame, similarity: float) -> DataFrame:
    """(key, size, h, n, own, head): nodes that share a key with one of like size, in groups by key and class of sizes.

    Classes are so wide that similar sets are in one class or in neighbours; a node is in the group of its own class and
    in that of the next, where it meets that class's own only. Rows are sent once, by key.
    """
    tasks = partitions(prints.sparkSession)
    keyed = prints.where("doc_id is not null").select("h", "n", "head", F.posexplode("prefix").alias("at", "key")).select("key", "h", F.col("n").cast("int").alias("n"), (F.col("at") < F.col("head")).alias("head"))
    # a key can come twice, from equal texts of several tasks or where hashes collide in a set
    each = keyed.repartition(tasks, "key").groupBy("key", "h").agg(F.max("n").alias("n"), F.max("head").alias("head"))
    own = F.floor(F.log(F.col("n").cast("double")) / (-math.log(similarity) + 1e-6)).cast("int")
    sizes = F.explode(F.array(F.struct(own.alias("size"), F.lit(True).alias("own")), F.struct((own + 1).alias("size"), F.lit(False).alias("own")))).alias("s")
    group = Window.partitionBy("key", "size")
    met = each.select("key", "h", "n", "head", sizes).select("key", "s.size", "h", "n", "s.own", "head")
    met = met.withColumn("nodes", F.count("*").over(group)).withColumn("owned", F.max("own").over(group)).withColumn("headed", F.max("head").over(group))
    return met.where("nodes > 1 and owned and headed").drop("nodes", "owned", "headed")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048, rounds: int = 3, sample: int = 2_000, distance: int = 3) -> DataFrame:
    """doc_id and component_id, the least doc_id that links reach: texts whose distinct shingles have the Jaccard similarity or more.

    A text of fewer words than a shingle has one shingle, all of it; null and empty texts have none and are equal to
    each other. A row with a null id is returned with its equals' component, or null if none of them has an id, and
    links no others. Repeated rows are returned as often as they come; an empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(spark) as keep:
        prints = keep(prints_of(rows, shingle, similarity, *common_shingles(rows, shingle, sample, 100_000)))
        nodes = keep(prints.groupBy("h").agg(F.min("doc_id").alias("node"), *(F.max(c).alias(c) for c in ("n", "fp", "sketch", *PIVOTS))).where("node is not null"))

        def decided(near: DataFrame) -> tuple[DataFrame, DataFrame]:
            """Of the pairs (a, b, both): those that were compared, and the links."""
            compared = keep(by_sketches(keep(near), nodes, similarity))
            return compared, keep(verified(compared, rows, nodes, shingle, similarity, keep))

        def joined(links: DataFrame) -> DataFrame:
            """(h, c) of the nodes that have links: as links, all that the next round needs of those before it."""
            return connected_components(links, keep=keep).select(F.col("node").alias("h"), F.col("component").alias("c"))

        def small(table: DataFrame) -> DataFrame:
            return F.broadcast(table) if table.count() <= MOST_BROADCAST else table

        # fingerprints within a few bits, and the sets of each of their components compared with one of it
        alike = connected_components(fingerprint_links(nodes.select("fp", F.col("fp").alias("node")).distinct(), distance), keep=keep)
        alike = nodes.select("h", "fp").join(alike.select(F.col("node").alias("fp"), "component"), "fp", "left").select("h", F.coalesce("component", "fp").alias("of"))
        pairs = alike.join(alike.groupBy("of").agg(F.min("h").alias("a")), "of").where("h <> a").select("a", F.col("h").alias("b"))
        tried, links = decided(by_pivots(pairs, nodes, similarity))
        # the rest, by shared keys
        state = keep(shared_keys(prints, similarity))
        group, before = Window.partitionBy("key", "size"), None
        named_by = lambda rows, stars: rows.join(small(stars), "h", "left").withColumn("c", F.coalesce("c", "h"))
        for i in range(rounds + 1):
            stars = joined(links)
            met = named_by(state.select("key", "size", "h", "n", "own", "head"), stars)
            one = F.min(F.struct(F.xxhash64("h", F.lit(i)), "h", "c", "n", "own", "head"))
            # by windows: the rows are sent once a round, before the windows' structs are made, and written down once; they are read twice
            met = met.repartition(partitions(spark), "key", "size")
            ends = {"lo": F.min("c").over(group), "hi": F.max("c").over(group), "count": F.count("*").over(group), "one": one.over(group)}
            left = keep(met.withColumns(ends).where("lo <> hi").drop("lo", "hi"))
            keep.drop(state)
            state, rows_left = left, left.count()
            # a round that took few rows away is the last, as it costs what it would save
            if i == rounds or (before is not None and rows_left >= WORTH_A_ROUND * before):
                break
            before = rows_left
            fit = (F.col("own") | F.col("one.own")) & (F.col("head") | (F.col("n") > F.col("one.n"))) & (F.col("one.head") | (F.col("one.n") > F.col("n")))
            fit = fit & (F.least("n", "one.n") >= similarity * F.greatest("n", "one.n") - 1e-6) & (F.col("c") != F.col("one.c"))
            pairs = state.where(fit).select(F.least("h", "one.h").alias("a"), F.greatest("h", "one.h").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            compared, found = decided(by_pivots(pairs, nodes, similarity))
            tried, links = tried.union(compared), stars.select(F.col("h").alias("a"), F.col("c").alias("b")).union(found)

        slices = F.ceil(F.col("count") / tile).cast("int")
        rows_of = lambda of: of.select("key", "size", "h", "c", "n", "own", "head", slices.alias("slices"))

        def paired(cut: DataFrame, most: int | None = None) -> DataFrame:
            """Pairs (a, b, both) of the rows of a tile that were not compared; cut has the slice of each row, and its tile."""
            cut = cut.drop("slices").join(nodes.select("h", *PIVOTS), "h").repartition(partitions(spark), "key", "size", "tile").sortWithinPartitions("key", "size", "tile")
            return cut.mapInPandas(pairs_in(similarity, most), "a long, b long, both long").distinct().join(tried, ["a", "b"], "left_anti")

        # in large groups, each component's nearest first: their rows are sent once a round, dealt to other slices each time
        last, large, most, turn = state, state.where(F.col("count") > LARGE), NEAREST, 0
        while not large.isEmpty():
            own = F.pmod(F.xxhash64("h", F.lit(turn)), F.col("slices")).cast("int")
            cut = rows_of(large).withColumn("slice", own).withColumn("tile", F.col("slice").cast("long") * (SLICES + 1))
            compared, found = decided(paired(cut, most))
            tried, links = tried.union(compared), stars.select(F.col("h").alias("a"), F.col("c").alias("b")).union(found)
            asked, got = compared.count(), found.count()
            if got:
                stars = joined(links)
                now = named_by(state.where(F.col("count") > LARGE).drop("c", "one"), stars)
                several = now.groupBy("key", "size").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "size")
                large = keep(now.join(several, ["key", "size"], "left_semi"))
                last = named_by(state.where(F.col("count") <= LARGE).drop("c", "one"), stars).unionByName(large)
            if most >= MOST_NEAREST and 10 * got <= asked:
                break
            most, turn = MOST_NEAREST, turn + 1

        # all pairs of what is left
        own = F.pmod(F.xxhash64("h", F.lit(8)), F.col("slices")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.least(s, F.col("slice")).cast("long") * SLICES + F.greatest(s, F.col("slice")))
        _, found = decided(paired(rows_of(last).withColumn("slice", own).withColumn("tile", F.explode(tiles))))
        links = stars.select(F.col("h").alias("a"), F.col("c").alias("b")).union(found)
        named = lambda c: nodes.select(F.col("h").alias(c), F.col("node").alias(f"node_{c}"))
        edges = links.join(named("a"), "a").join(named("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        component = connected_components(edges, keep=keep)
        out = nodes.join(component, "node", "left").select("h", F.coalesce("component", "node").alias("component_id"))
        return keep.result(prints.join(out, "h", "left").select("doc_id", "component_id"))
