"""The tree of conversations that begin alike, without building a tree anywhere.

Each prefix of a conversation has a digest; the least conversation among those that share it owns it. Who owns a prefix
owns all longer ones of its own, so a conversation's nodes are one chain, from its first owned depth to its end, and a
binary search finds that depth: every round, all conversations probe the owners' table with the digest in the middle
of what is left to search. Chains hang on other chains; sums over subtrees are doubled up that tree of chains, then run along
each chain. Texts are digested where they are read and never shuffled.

No step takes a whole conversation, prefix or chain into one task: turns are numbered by ranges, paths are searched
and summed in stretches of `STRETCH` turns, members of a prefix are joined to text range by range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Turns that are searched, or summed by one window, together.
STRETCH = 1024

#: Rows of one conversation and turn are ordered by role, then by so many characters of the text, then by the digest of the whole.
TIE_CHARS = 64

NOTHING = hashlib.sha256(b"").hexdigest()


def turn_marks(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, head (of the text, for ties), mark (SHA-256 of role and text), size (UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("head"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    return rows.where("conv_id IS NOT NULL")


def numbered(marks: DataFrame, keep: Scratch) -> DataFrame:
    """conv_id, pos (from 1, by turn with nulls first), mark, size.

    Ranges of the order are numbered one by one; a conversation that a border cuts starts where its earlier ranges
    end. There is one such row a border at most, so these are broadcast.
    """
    order = ["turn", "role", "head", "mark"]
    cut = keep(marks.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(marks.sparkSession), "conv_id", *order, "row").drop("row").withColumn("part", F.spark_partition_id()))
    counts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    skips = counts.select("conv_id", "part", earlier.alias("skip")).where("skip IS NOT NULL")
    local = cut.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return local.join(F.broadcast(skips), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("skip", F.lit(0))).alias("pos"), "mark", "size")


def running(rows: DataFrame, key: str, at: str, columns: list[str], total, add, backwards: bool = False) -> DataFrame:
    """Replaces columns by their running totals along `at` (1, 2, ...) within `key`, stretch by stretch; rows should be written down.

    total is an aggregate, add joins two of its values.
    """
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    rows = rows.withColumn("stretch", F.floor((F.col(at) - 1) / STRETCH))
    within = Window.partitionBy(key, "stretch").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(way("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(key, "stretch").agg(*(total(c).alias(c) for c in columns))
    carry = stretches.select(key, "stretch", *(total(c).over(earlier).alias(f"carry_{c}") for c in columns)).where(F.col(f"carry_{columns[0]}").isNotNull())
    rest = [c for c in rows.columns if c not in columns]
    inside = rows.select(*rest, *(total(c).over(within).alias(c) for c in columns))
    return inside.join(carry, [key, "stretch"], "left").select(*rest, *(add(F.col(c), F.coalesce(f"carry_{c}", F.lit(0))).alias(c) for c in columns))


def first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, first: the least depth that each conversation owns, if any.

    Every round joins the middle prefix of each stretch with its owner and keeps the half in which ownership begins,
    so rows halve from round to round; a stretch that has been searched waits under a key that no prefix has.
    """
    path = F.sort_array(F.collect_list(F.struct("depth", "a", "b")))
    left = prefixes.groupBy("conv_id", "stretch").agg(path.alias("path")).withColumn("found", F.lit(None).cast("long"))
    longest = min(STRETCH, prefixes.agg(F.max("depth")).first()[0] or 0)
    owners = minima.select("depth", "a", "b", "owner")
    for _ in range(math.ceil(math.log2(longest + 1))):
        open_, middle = F.size("path") > 0, F.floor(F.size("path") / 2).cast("int")
        probe = F.when(open_, F.get("path", middle)).otherwise(F.struct(F.lit(-1).cast("long").alias("depth"), F.col("conv_id").alias("a"), F.col("stretch").alias("b")))
        left = left.select("*", probe.alias("probe"), middle.alias("middle")).select("*", "probe.*").join(owners, ["depth", "a", "b"], "left")
        mine = F.col("owner") == F.col("conv_id")
        half = F.when(F.col("owner").isNull(), F.col("path")).when(mine, F.slice("path", F.lit(1), F.col("middle"))).otherwise(F.slice("path", F.col("middle") + 2, F.greatest(F.size("path") - F.col("middle") - 1, F.lit(0))))
        left = left.select("conv_id", "stretch", half.alias("path"), F.when(mine, F.col("depth")).otherwise(F.col("found")).alias("found"))
    return left.groupBy("conv_id").agg(F.min("found").alias("first"))


def over_subtrees(chains: DataFrame, columns: list[str], spark_keep: Scratch) -> DataFrame:
    """conv_id and the columns, each summed over the chain and all that hang on it, directly or not.

    Bottom-up by doubling: after k rounds a chain holds what is less than 2^k below it, and `up` is its 2^k-th ancestor;
    so there are as many rounds as the logarithm of the tree's height.
    """
    sums = chains.select("conv_id", "up", *columns)
    while not (moving := sums.where("up IS NOT NULL")).isEmpty():
        lifted = moving.groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(c).alias(f"more_{c}") for c in columns))
        higher = moving.select("conv_id", "up").join(sums.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up").select("conv_id", "next")
        joined = sums.drop("up").join(lifted, "conv_id", "left").join(higher, "conv_id", "left")
        sums = spark_keep(joined.select("conv_id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns)))
    return sums.drop("up")


def member_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each run of one node as decimal text; rows are sorted, a batch holds 10,000 of them at most."""
    for batch in batches:
        owner, depth, member = (np.asarray(batch.column(c)) for c in ("owner", "depth", "conv_id"))
        if len(member):
            at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])])
            text = [",".join(map(str, member[i:j].tolist())) for i, j in zip(at, [*at[1:], len(member)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(depth[at]), pa.array(member[at]), pa.array(text, pa.string())], names=["owner", "depth", "least", "members"])


def joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, comma-joined; they come in order, and only the state of one digest is held."""
    node, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["owner", "depth", "ends_sha256"])

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for owner, depth, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "members")), strict=True):
            if node == (owner, depth):
                state.update(b"," + text.encode())
                continue
            if node is not None:
                done.append(out())
            node, state = (owner, depth), hashlib.sha256(text.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if node is not None:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of ends(owner, depth, conv_id). The digest is one sequence, the texts it reads are made in ranges."""
    n = partitions(ends.sparkSession)
    order = ["owner", "depth", "conv_id"]
    texts = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(member_texts, "owner long, depth long, least long, members string")
    return texts.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "least").mapInArrow(joined_digests, "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node of the prefix tree: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv_id, depth, mark, size) has each conversation's turns at depths 1, 2, ... without gaps, members(conv_id,
    length) all conversations, also those without turns. Two sequences are the same if their 128-bit digests are;
    a digest is the exclusive or of hashes of (depth, mark), so that it can be run over stretches. saved_tokens counts
    bytes of the last turn that members need not repeat. No members give no rows. Null ids are not allowed here.

    The result is written to the shared folder, and all tables on the way are removed.
    """
    spark = turns.sparkSession
    with Scratch(spark) as keep:
        root = members.agg(F.min("conv_id"), F.count("*")).first()
        lanes = keep(turns.select("conv_id", "depth", "size", F.xxhash64("depth", "mark").alias("a"), F.xxhash64("mark", F.lit(7), "depth").alias("b")))
        prefixes = keep(running(lanes, "conv_id", "depth", ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y)))
        minima = keep(prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
        owners = minima.select("depth", "a", "b", "owner")
        firsts = keep(first_owned(prefixes, minima).join(members, "conv_id"))

        # what each chain hangs on: the owner of the prefix before its first one, none at depth 0
        hung = firsts.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")).join(prefixes, ["conv_id", "depth"]).join(owners, ["depth", "a", "b"]).select("conv_id", F.col("owner").alias("up"))
        saved = F.sum((F.col("n_convs") - 1) * F.col("size"))
        own = minima.groupBy(F.col("owner").alias("conv_id")).agg(saved.alias("saved"))
        chains = keep(firsts.where("first IS NOT NULL").join(hung, "conv_id", "left").join(own, "conv_id"))
        borne = chains.where("up IS NOT NULL").select(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("length")).distinct()
        bare = chains.join(borne.withColumn("bears", F.lit(True)), ["conv_id", "length"], "left")
        chains = keep(bare.select("conv_id", "first", "length", "up", "saved", F.when(F.col("bears"), 0).otherwise(1).cast("long").alias("leaves")))

        below = over_subtrees(chains, ["leaves", "saved"], keep)
        hanging = chains.where("up IS NOT NULL").select("conv_id", F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).join(below, "conv_id")
        hanging = hanging.groupBy("owner", "depth").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("own")).join(chains.select(F.col("conv_id").alias("owner"), "first", "length", "up"), "owner").join(hanging, ["owner", "depth"], "left")
        n_children = F.coalesce("n", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")
        nodes = keep(nodes.select("owner", "depth", "n_convs", "first", "up", n_children.alias("n_children"), (F.coalesce("leaves", F.lit(0)) + (n_children == 0).cast("long")).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("saved_tokens")))
        nodes = running(nodes, "owner", "depth", ["n_leaves", "saved_tokens"], F.sum, lambda x, y: x + y, backwards=True)
        parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.coalesce("up", F.lit(root[0])))
        nodes = nodes.select("owner", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")

        totals = chains.agg(F.sum("leaves"), F.sum("saved"), F.sum(F.when(F.col("first") == 1, 1))).first()
        top = spark.createDataFrame([(root[0], 0, None, root[1], totals[2] or 0, totals[0] or 1, totals[1] or 0)] if root[1] else [], "owner long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")

        at_own = firsts.where("first IS NOT NULL").select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"), "conv_id")
        at_others = firsts.where("first IS NULL").select("conv_id", F.col("length").alias("depth")).join(prefixes, ["conv_id", "depth"]).join(owners, ["depth", "a", "b"]).select("owner", "depth", "conv_id")
        at_root = members.where("length = 0").select(F.lit(root[0]).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")
        ends = end_digests(at_own.union(at_others).union(at_root))
        done = nodes.union(top).join(ends, ["owner", "depth"], "left")
        return keep.result(done.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of conversations(conv_id, turn, role, text) as they are.

    Turns are ordered by turn, nulls first; rows of one turn as TIE_CHARS says, repeated rows are turns like others.
    A null role or text is empty. Rows without conv_id belong to no conversation. Other columns are not read.
    """
    with Scratch(conversations.sparkSession) as keep:
        turns = keep(numbered(turn_marks(conversations), keep))
        members = keep(turns.groupBy("conv_id").agg(F.max("pos").alias("length")))
        return prefix_trie(turns.withColumnRenamed("pos", "depth"), members)


def forked(conversations: DataFrame, keep: Scratch, fan: int = 5, most_shared: int = 8) -> tuple[DataFrame, DataFrame]:
    """turns and members of conversations rebuilt as forks: the first h turns of conversation c - c % fan, then c's own after its first h.

    h is the unsigned CRC-32 of the decimal c, modulo most_shared + 1. Nulls, ties and repeated rows are as in conversation_trie.
    """
    turns = keep(numbered(turn_marks(conversations), keep))
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select(c, "own", (c - c % fan).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (most_shared + 1)).alias("h"))
    bases = own.select(c.alias("base"), F.col("own").alias("there"))
    given = F.least("h", F.coalesce("there", F.lit(0)))
    forks = keep(own.join(bases, "base", "left").select("conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    kept = turns.join(forks.select("conv_id", "h", "given"), "conv_id").where("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "mark", "size")
    heads = turns.where(F.col("pos") <= most_shared).select(c.alias("base"), F.col("pos").alias("depth"), "mark", "size")
    lent = heads.join(forks.select("conv_id", "base", "given"), "base").where("depth <= given").select("conv_id", "depth", "mark", "size")
    return keep(kept.union(lent)), forks.select("conv_id", "length")
