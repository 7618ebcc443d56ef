"""Substring dedup: Rabin-Karp hashes of every window of words, resolved in Spark, repeats merged to intervals.

Documents are dealt to chunks by a hash of id and text. A chunk hashes every window of its documents twice
(two bases): the second hash picks a bucket, the first is what the bucket compares. Each chunk sends a bucket
its distinct hashes only, with the earliest document that has each, sorted and delta-coded, so that a window
that a third of the corpus holds costs one entry a chunk. The bucket sees every window hash of the corpus that
falls to it, and answers each chunk with one bit per hash: does it start in an earlier document elsewhere?
The chunk then merges its repeated windows into maximal intervals.

Order of documents: id ascending, null ids last; rows with one id are ordered by chunk and then by text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, word_list

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LAST_ID = np.iinfo(np.int64).max


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 20)
        return h


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of each window of `size` words, by doubling: size is the sum of its powers of two."""
    out, done, power, length, factor = None, 0, words, 1, base
    n = len(words) - size + 1
    while True:
        if size & length:
            out = power[:n].copy() if out is None else out * np.uint64(factor) + power[done : done + n]
            done += length
        if done == size:
            break
        power = power[: len(power) - length] * np.uint64(factor) + power[length:]
        length, factor = length * 2, factor * factor % 2**64
    # fold the high half down: the low bits of a product depend on low bits only
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out


def chunk_windows(texts, size: int):
    """Words of each document; hashes, bucket hashes, document ordinal and start of every window, in order."""
    cache = WordHashes()
    docs, first, second, which, start = [], [], [], [], []
    for i, text in enumerate(texts):
        words = word_list(text)
        docs.append(words)
        if len(words) >= size:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            first.append(rolling(h, size, BASES[0]))
            second.append(rolling(h, size, BASES[1]))
            which.append(np.full(len(first[-1]), i, np.int32))
            start.append(np.arange(len(first[-1]), dtype=np.int32))
    if not first:
        return docs, *(np.empty(0, t) for t in (np.uint64, np.uint64, np.int32, np.int32))
    return docs, *map(np.concatenate, (first, second, which, start))


def distinct_windows(first: np.ndarray, bucket: np.ndarray):
    """Index of the first window of each (bucket, hash), sorted by it; and for every window the place of its own in that list."""
    order = np.lexsort((first, bucket))  # stable: equal hashes stay in document order
    b, h = bucket[order], first[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def packed(values: np.ndarray) -> bytes:
    """64-bit values as byte planes under zstd: small values leave the high planes empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def in_order(chunk: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, ids and whether they are null, of a chunk in the order of documents."""
    chunk = chunk.sort_values(["_null", "_id", "_text"], kind="stable", na_position="first")
    return chunk["_text"].tolist(), chunk["_id"].to_numpy(), chunk["_null"].to_numpy()


def windows_of(size: int, buckets: int):
    def send(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        texts, ids, _ = in_order(chunk)
        _, first, second, which, _ = chunk_windows(texts, size)
        bucket = (second % np.uint64(buckets)).astype(np.int64)
        at, _ = distinct_windows(first, bucket)
        cut = np.flatnonzero(np.diff(bucket[at], prepend=-1))
        rows = []
        for a, b in zip(cut, np.r_[cut[1:], len(at)], strict=False):
            own = at[a:b]
            hashes = first[own]
            rows.append((bucket[own[0]], key[0], packed(np.diff(hashes, prepend=np.uint64(0))), packed(ids[which[own]])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "ids"])

    return send


def earlier(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's list of hashes in this bucket, a bit per hash: another chunk has it in an earlier document."""
    blobs = blobs.sort_values("chunk", kind="stable")
    hashes = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in blobs["hashes"]]
    h, ids = np.concatenate(hashes), np.concatenate([unpacked(x, np.int64) for x in blobs["ids"]])
    order = np.lexsort((ids, h))  # ties between chunks: the smaller chunk is first
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(again, cuts)]
    return pd.DataFrame({"chunk": blobs["chunk"].to_numpy(), "bucket": key[0], "bits": bits})


def merged(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) covered by windows at these sorted starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > size)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + size


def removed_by(size: int, buckets: int):
    def judge(key: tuple, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts, ids, unnamed = in_order(chunk)
        docs, first, second, which, start = chunk_windows(texts, size)
        bucket = (second % np.uint64(buckets)).astype(np.int64)
        at, place = distinct_windows(first, bucket)
        repeated = np.zeros(len(at), bool)
        if len(at):
            lo, hi = (dict(zip(*np.unique(bucket[at], return_index=True), strict=True)), np.r_[np.flatnonzero(np.diff(bucket[at])) + 1, len(at)])
            ends = dict(zip(lo, hi, strict=True))
            for b, bits in zip(answers["bucket"], answers["bits"], strict=True):
                n = ends[b] - lo[b]
                repeated[lo[b] : ends[b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        again = repeated[place]
        later = np.ones(len(place), bool)
        later[at] = False
        again |= later
        bounds = np.searchsorted(which, np.arange(len(docs) + 1))
        rows = []
        for i, words in enumerate(docs):
            own = slice(bounds[i], bounds[i + 1])
            a, b = merged(start[own][again[own]], size)
            kept, done = [], 0
            for s, e in zip(a, b, strict=True):
                kept += words[done:s]
                done = e
            kept += words[done:]
            spans = [(int(s), int(e)) for s, e in zip(a, b, strict=True)]
            rows.append((None if unnamed[i] else int(ids[i]), len(words), int((b - a).sum()), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
        return out.astype({"doc_id": "Int64"})

    return judge


def sizes(total: int, chunk: int, bucket: int, most: int) -> tuple[int, int]:
    """Numbers of chunks and of buckets: of the sizes asked for while their product is `most` or less; beyond, both sizes
    grow with the square root of the total, so that the product grows in proportion to it."""
    wide = max(1.0, total / math.sqrt(most * chunk * bucket)) ** 0.5
    return math.ceil(total / (chunk * wide)), math.ceil(total / (bucket * wide))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8_000_000, bucket_windows: int = 1_000_000, most_messages: int = 20_000_000) -> DataFrame:
    """Remove every word covered by a window of `window` words whose words also start earlier in the corpus.

    Returns doc_id, n_words, n_removed, spans (array of [start, end) word ranges) and kept_text (kept words joined
    by one space). A null or empty text has no words; a text shorter than the window loses none; an empty table gives
    no rows; repeated rows are documents of their own, all but the first of which are removed whole; other columns
    are not read. Ids are integers, or strings of digits.

    A chunk and a bucket meet in one message, so chunks times buckets must not grow with the square of the corpus: up
    to `most_messages` their sizes are chunk_bytes and bucket_windows, beyond it both grow with the square root of the
    corpus. Groups, however large, do not add to a task's memory. Each chunk and each bucket is a task of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_null", F.col("_id").isNull())
    rows = rows.withColumn("_id", F.coalesce("_id", F.lit(int(LAST_ID))))  # whole numbers all, which pandas keeps as they are
    total = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    chunks, buckets = sizes(total, chunk_bytes, 6 * bucket_windows, most_messages)
    chunks, buckets = max(partitions(spark), chunks), max(partitions(spark), buckets)
    salt = F.pmod(F.xxhash64("_id", "_text", F.lit(7)), F.lit(chunks))
    rows = rows.withColumn("chunk", salt).repartition(chunks, "chunk")
    sent = rows.groupBy("chunk").applyInPandas(windows_of(window, buckets), "bucket long, chunk long, hashes binary, ids binary")
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(earlier, "chunk long, bucket long, bits binary")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(removed_by(window, buckets), schema)
