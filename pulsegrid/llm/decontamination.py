"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask reads some of the tokens under it and ignores the others. Each mask is hashed at every position of every
document and of every benchmark item; equal hashes are hits, and around each hit the aligned tokens are compared:
a document is contaminated by an item if some `window` aligned tokens agree in `similarity` of them or more.

Windows of 13 tokens with two substitutions have the two masks below, found by search. Others, such as items shorter
than a window, have masks made by rule: positions are dealt to classes in turn, two classes more than there may be
substitutions, and each mask ignores one choice of as many classes as there may be substitutions. Whatever falls out,
some mask reads none of it. Tests try all placements for lengths of 5 to 13.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets of the tokens that a mask reads, for windows of 13 and two substitutions. Six of eight each, found by search for full sensitivity.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8


def masks_for(length: int, similarity: float) -> list[tuple[int, ...]]:
    """Places to read, in windows of this length, by which no allowed number of substitutions hides a window from all masks."""
    least = ceil(similarity * length - 1e-9)
    lost = length - least
    if (length, lost) == (13, 2):
        return list(MASKS)
    if lost == 0 or least <= 1:
        return [tuple(range(length))] if lost == 0 else [(i,) for i in range(length)]
    classes = min(lost + 2, length)
    return [tuple(i for i in range(length) if i % classes not in gone) for gone in combinations(range(classes), lost)]


def tokens(text):
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """A row per position and mask: what `keep` names, pos and seed. Needs the token hashes in column w; masks start at 0."""
    at = rows.select(*keep, "w", F.posexplode_outer("w").alias("pos", "_"))
    hashed = [F.when(F.col("pos") + m[-1] < F.size("w"), F.xxhash64(F.lit(str(m)), *(F.get("w", F.col("pos") + o) for o in m))) for m in masks]
    return at.select(*keep, "w", "pos", F.explode(F.array(*hashed)).alias("seed")).where("seed is not null")


def from_zero(mask: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(o - mask[0] for o in mask)


def around(tokens_: str, pos: str, reach: int):
    """The tokens that any window around a hit can reach, and no more."""
    return F.slice(tokens_, F.greatest(F.col(pos) - reach + 1, F.lit(1)), F.lit(2 * reach + 1))


def item_seeds(items: DataFrame, lengths: list[int], window: int, similarity: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(seed, k, qpos, span) of all items, and the masks that documents are to be read by.

    An item of `window` tokens or more is read at every position, a shorter one as one window of its own length.
    Positions of an item that look alike as far as a window reaches are one.
    """
    wide = [from_zero(m) for m in masks_for(window, similarity)]
    masks, out = list(dict.fromkeys(wide)), None
    for n, mask, first in [(None, m, 0) for m in masks] + [(n, from_zero(m), m[0]) for n in lengths for m in masks_for(n, similarity)]:
        part = seeds(items.where(F.col("n") >= window if n is None else F.col("n") == n), [mask], "k")
        part = part if n is None else part.where(F.col("pos") == first)
        context = F.xxhash64(F.transform(F.sequence(F.col("pos") - window, F.col("pos") + window), lambda i: F.coalesce(F.get("w", i), F.lit(0).cast("long"))))
        part = part.groupBy("seed", "k", context.alias("context")).agg(F.min("pos").alias("qpos")).select("seed", "k", "qpos", F.lit(mask[-1] + 1).alias("span"))
        out = part if out is None else out.union(part)
        masks.append(mask)
    return out, list(dict.fromkeys(masks))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_broadcast: int = 2_000_000
) -> DataFrame:
    """A row per document and item that overlap: doc_id, item_id, window (tokens compared) and best_overlap (most that agree).

    An item of fewer tokens than `window` is compared whole, and as many of its tokens must agree as `similarity` asks
    for, rounded up. A window may hang over an end of the document: what is not there does not agree.
    Null or empty texts have no tokens and overlap nothing; rows that share an id count as one document or item, and
    rows without an id as one with a null id; other columns are not read. Items of up to `most_broadcast` tokens in all are
    broadcast, more are joined by shuffle.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("k", F.xxhash64("item_id", "w"))  # names a row even where ids are null or repeated
    sizes = items.agg(F.sum("n").alias("total"), F.array_sort(F.collect_set(F.when(F.col("n") < window, F.col("n")))).alias("short")).first()
    small = (sizes["total"] or 0) <= most_broadcast
    side = F.broadcast if small else (lambda x: x)
    listed, masks = item_seeds(items, sizes["short"] or [], window, similarity)  # fewer than `window` lengths

    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    reach = window - 1
    found = seeds(rows, masks, "doc_id")
    if small:
        hits = found.join(side(listed), "seed").select("doc_id", "k", "qpos", "span", around("w", "pos", reach).alias("near"), F.least("pos", F.lit(reach)).alias("at"))
    else:  # only what a hit needs goes through the shuffle, not the document
        hits = found.select("doc_id", "seed", around("w", "pos", reach).alias("near"), F.least("pos", F.lit(reach)).alias("at")).join(listed, "seed").drop("seed")
    hits = hits.join(side(items.select("k", "item_id", F.col("w").alias("q"), F.least("n", F.lit(window)).alias("len")).dropDuplicates(["k"])), "k")
    back = F.col("len") - F.col("span")
    same = F.transform(F.sequence(-back, F.col("len") - 1), lambda o: F.coalesce((F.get("near", F.col("at") + o) == F.get("q", F.col("qpos") + o)).cast("int"), F.lit(0)))
    hits = hits.select("doc_id", "item_id", "len", back.alias("back"), same.alias("same"))
    agree = F.transform(F.sequence(F.lit(0), F.col("back")), lambda a: F.aggregate(F.slice("same", a + 1, F.col("len")), F.lit(0), lambda x, y: x + y))
    found = hits.select("doc_id", "item_id", "len", F.array_max(agree).alias("agree"))
    found = found.where(F.col("agree") >= F.ceil(F.lit(similarity) * F.col("len") - 1e-9))
    return found.groupBy("doc_id", "item_id").agg(F.max("len").cast("long").alias("window"), F.max("agree").cast("long").alias("best_overlap"))
