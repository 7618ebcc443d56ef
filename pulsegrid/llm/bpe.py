"""Byte-level BPE by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a token is answered by one probe and one
comparison. Tier two takes the misses: their bytes form a linked list, a heap gives the lowest-ranked adjacent pair,
and stale heap entries are skipped, so a pre-token of n bytes costs n log n however long it is.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks; ranks are 0 to n - 1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: each bucket of keys gets a seed that sends its keys to free slots, and
    a bucket of one key names its slot.

    find(key) is the key's rank or -1: the slot's own key is compared, so strangers are never taken for members.
    """

    def __init__(self, keys: list[bytes], load: int = 3):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            by[xxhash.xxh64_intdigest(key) % self.buckets].append(i)
        self.seeds, self.slots = [0] * self.buckets, [-1] * self.n
        free = [True] * self.n
        self.keys, spare = keys, iter(range(self.n))
        for bucket in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            if len(by[bucket]) == 1:  # the last and most crowded ones: any free slot, named outright
                place = next(p for p in spare if free[p])
                self.slots[place], free[place], self.seeds[bucket] = by[bucket][0], False, -1 - place
                continue
            seed = 1
            while by[bucket]:
                places = [xxhash.xxh64_intdigest(keys[i], seed) % self.n for i in by[bucket]]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    for i, p in zip(by[bucket], places, strict=True):
                        self.slots[p], free[p] = i, False
                    break
                seed += 1
            self.seeds[bucket] = seed

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        rank = self.slots[-1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n]
        return rank if self.keys[rank] == key else -1


def merge(piece: bytes, find) -> tuple[int, ...]:
    """Ranks of a pre-token that is no token itself: lowest-ranked adjacent pair first, the leftmost of equals."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], k = 0, stop, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := find(piece[i : end[k]])) >= 0:
                heapq.heappush(heap, (r, i, end[k]))
        if (p := before[i]) >= 0 and (r := find(piece[p:stop])) >= 0:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(find(piece[i : end[i]]))
        i = after[i]
    return tuple(out)


class Remembered(dict):
    """Answers of `ask` by key. Of those before the last `most` new ones only the ones that were asked for again are held, so
    that what comes often stays and a worker's memory does not follow the number of distinct keys."""

    def __init__(self, ask, most: int = 250_000):
        self.ask, self.most, self.older = ask, most, {}

    def __missing__(self, key):
        answer = self.older.pop(key, None)
        if answer is None:
            answer = self.ask(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 256:
            self[key] = answer
        return answer


class Encoder(Remembered):
    """Pre-token to its ranks, packed as unsigned 32-bit integers."""

    def __init__(self, table: PerfectHash, most: int = 250_000):
        self.table, self.pairs = table, Remembered(table.find, most)
        super().__init__(self.ranks, most)

    def ranks(self, token: str) -> bytes:
        piece = utf8(token)
        rank = self.table.find(piece)
        if rank >= 0:
            return pack("I", rank)
        ids = merge(piece, self.pairs.__getitem__ if len(piece) <= 256 else self.table.find)
        return pack(f"{len(ids)}I", *ids)


def encode(text: str | None, encoder: Encoder, cut) -> bytes:
    if not text:
        return b""
    return b"".join(map(encoder.__getitem__, (m.group() for m in cut.finditer(text)) if len(text) > 1_000_000 else cut.findall(text)))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit ids) and decoded (binary: the bytes the ids stand for).

    A null or empty text has no ids; no special tokens are known; other columns are not read; repeated rows are
    encoded each; an empty table gives no rows. The rank file is read on the driver and broadcast: its size is that
    of a vocabulary and checked against 64 MB.
    """
    spark = docs.sparkSession
    tokens = read_ranks(ranks_path)
    if sum(map(len, tokens)) > 64_000_000:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    table = PerfectHash(tokens)
    shared = spark.sparkContext.broadcast((table.keys, table.seeds, table.slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PerfectHash.__new__(PerfectHash)
        own.keys, own.seeds, own.slots = shared.value
        own.n, own.buckets = len(own.keys), len(own.seeds)
        names = np.array(own.keys, object)
        encoder, cut = Encoder(own), regex.compile(pattern)
        for batch in batches:
            ids, decoded = [], []
            for text in batch["text"]:
                got = np.frombuffer(encode(text, encoder, cut), np.uint32) if text else np.empty(0, np.uint32)
                ids.append(got.astype("<u4", copy=False).tobytes())
                decoded.append(b"".join(names[got].tolist()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids, "decoded": decoded})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary, decoded binary")
