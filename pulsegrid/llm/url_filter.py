"""URL filters: exact list membership by a Bloom filter cascade over the corpus's own keys.

Level 1 holds the listed keys. Every key of the corpus that is not listed but passes level 1 goes to level 2, the
listed keys that pass level 2 go to level 3, and so on until a level lets nothing wrong through. A key's answer is
the parity of the first level that refuses it: exact for every key of the corpus (and for the listed ones), without
a join and without shipping the list.

A key is a host suffix plus a path prefix, like `example.com/en/`: a rule covers its host, all subdomains, and all
paths that start with its path. The longest listed key of a URL decides; one cascade holds the block list, one the
allow list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

SEEDS = (0x51, 0xA7)  # two independent 64-bit hashes of a key


def key_hashes(key: Column) -> Column:
    return F.array(*(F.xxhash64(F.lit(s), key) for s in SEEDS))


class Bloom:
    """Bit array with positions h1 + i * h2, mixed with the level so that levels err independently."""

    def __init__(self, level: int, hashes: np.ndarray, rate: float):
        n = max(1, len(hashes))
        self.level, self.k = level, max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(n * self.k / math.log(2)))
        self.bits = np.zeros(-(-self.size // 8), np.uint8)
        for at in self.places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64((self.level * 0x9E3779B97F4A7C15) % 2**64)
        a = hashes[:, 0] ^ salt
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        a ^= a >> np.uint64(29)
        b = (hashes[:, 1] + salt) * np.uint64(0x81DADEF4BC2DD44D) | np.uint64(1)
        b ^= (b >> np.uint64(32)) << np.uint64(1)
        for i in range(self.k):
            yield (a + np.uint64(i) * b) % np.uint64(self.size)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


class Listed:
    """The end of a cascade, where levels no longer tell keys apart: the keys themselves, as an ascending table."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(np.ascontiguousarray(hashes).view("u8,u8").ravel())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(np.ascontiguousarray(hashes).view("u8,u8").ravel(), self.keys)


def answer(levels: list, hashes: np.ndarray) -> np.ndarray:
    """Listed or not: a key refused first at an even level (counted from 0) is not listed, at an odd one it is."""
    out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
    for i, level in enumerate(levels):
        passed = level.has(hashes[left])
        out[left[~passed]] = i % 2 == 1
        left = left[passed]
    out[left] = len(levels) % 2 == 1
    return out


def passes(levels: list, spark: SparkSession | None = None):
    """Pandas UDF: array of keys' hash pairs to array of listed flags. The levels are broadcast, if a session is given."""
    # plain values: a broadcast is unpickled where this package need not be installed
    plain = [(x.keys,) if isinstance(x, Listed) else (x.level, x.k, x.size, x.bits) for x in levels]
    shared = spark.sparkContext.broadcast(plain) if spark is not None else None

    def level_of(values: tuple):
        out = Listed.__new__(Listed) if len(values) == 1 else Bloom.__new__(Bloom)
        for name, value in zip(("keys",) if len(values) == 1 else ("level", "k", "size", "bits"), values, strict=True):
            setattr(out, name, value)
        return out

    @F.pandas_udf("array<boolean>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = [level_of(v) for v in (shared.value if shared is not None else plain)]
        for pairs in batches:
            flat = np.concatenate([np.empty(0, np.int64), *(np.concatenate(row) for row in pairs if len(row))]).view(np.uint64).reshape(-1, 2)
            yield pd.Series(np.split(answer(own, flat), np.cumsum(pairs.map(len).to_numpy())[:-1])) if len(pairs) else pd.Series([], dtype=object)

    return listed


def hash_table(keys: DataFrame) -> np.ndarray:
    """Rows (h: two longs) as an array of two columns, by Arrow."""
    got = keys.select(F.get("h", F.lit(0)).alias("a"), F.get("h", F.lit(1)).alias("b")).toArrow()
    return np.stack([got[c].to_numpy().view(np.uint64) for c in "ab"], 1) if got.num_rows else np.empty((0, 2), np.uint64)


def build_cascade(keys: DataFrame, listed: list[str], most_levels: int = 40) -> list:
    """Levels for the listed keys over the corpus's keys (column key; repeats are harmless).

    The corpus is read to count its keys, which sets level 1's error rate so that its false positives are about as many
    as the listed keys, and to gather those false positives; should they be over 20 times as many, level 1 is made anew
    with a quarter of the rate. All later levels hold subsets of the two. After most_levels, what still gets through is
    kept as it is, so that any cascade ends.
    """
    spark = keys.sparkSession
    if not listed:
        return []
    inside = hash_table(spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string").select(key_hashes(F.col("key")).alias("h")))
    universe = max(keys.agg(F.approx_count_distinct("key")).first()[0], 1)
    rate, most = min(0.5, max(len(inside), 1000) / universe), 20 * max(len(inside), 1000)
    while True:
        levels: list = [Bloom(0, inside, rate)]
        first = passes(levels, spark)
        wrong = keys.select(key_hashes(F.col("key")).alias("h")).where(F.get(first(F.array("h")), F.lit(0))).distinct()
        outside = hash_table(wrong.limit(most + 1))
        if len(outside) <= most:
            break
        rate /= 4
    outside = outside[~Listed(inside).has(outside)]
    while len(outside):
        inside, outside = outside, inside  # what the next level holds, and what it must refuse
        levels.append(Bloom(len(levels), inside, 0.5) if len(levels) < most_levels else Listed(inside))
        outside = outside[levels[-1].has(outside)]
    return levels


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without `://`."""
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return ascii_lower(host), path


def candidate_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Every key that could cover the URL, longest first: host suffixes of up to `labels` labels, as many as any listed
    key has, and path prefixes of the listed lengths. Keys of equal length are in alphabetical order."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths)), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    by_length = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.when(host != "", F.array_distinct(F.transform(by_length, lambda s: s["k"]))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = 64_000_000) -> DataFrame:
    """page_id, host, path, rule (the longest listed key that covers the URL, or null) and verdict.

    A URL that no listed key covers gets the verdict `default`: it is on neither list. A null URL has an empty host
    and path. Of listed keys of one length the alphabetically first decides; a key on both lists blocks. Each key takes
    some 40 bits of filter at most, and 40 bytes while the filter is made; lists beyond most_bytes of the latter are
    not broadcast but joined by key, with the same answers. Repeated rows are judged each, with null ids too; an empty
    table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    most_labels = max((k[: k.index("/")].count(".") + 1 for k in [*block, *allow]), default=1)
    lengths = sorted({len(k) - k.index("/") for k in [*block, *allow]}, reverse=True)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths, most_labels))
    if 40 * (len(block) + len(allow)) > most_bytes:
        return judge_by_join(rows, block, allow, default)
    keys = rows.select(F.explode("keys").alias("key"))
    flags = {}
    for name, listed in (("block", block), ("allow", allow)):
        flags[name] = passes(build_cascade(keys, listed), spark)(F.col("hashes"))
    rows = rows.withColumn("hashes", F.transform("keys", key_hashes)).select("page_id", "host", "path", "keys", flags["block"].alias("b"), flags["allow"].alias("a"))
    marked = F.filter(F.arrays_zip("keys", "b", "a"), lambda z: z["b"] | z["a"])
    rows = rows.select("page_id", "host", "path", F.get(marked, F.lit(0)).alias("hit"))
    verdict = F.when(F.col("hit").isNull(), F.lit(default)).when(F.col("hit")["b"], "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("hit")["keys"].alias("rule"), verdict.alias("verdict"))


def judge_by_join(rows: DataFrame, block: list[str], allow: list[str], default: str) -> DataFrame:
    """The way for lists too long to broadcast: one shuffle join of the corpus's distinct keys with the list."""
    spark = rows.sparkSession
    verdicts = {k: "allow" for k in allow} | {k: "block" for k in block}
    listed = spark.createDataFrame(list(verdicts.items()), "key string, verdict string")
    places = rows.select("host", "path", "keys").distinct()
    hits = places.select("host", "path", F.explode("keys").alias("key")).join(listed, "key")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "verdict")).alias("hit"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("hit")["key"].alias("rule"), F.coalesce(F.col("hit")["verdict"], F.lit(default)).alias("verdict"))
