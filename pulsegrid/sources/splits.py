"""Large packet files read by many tasks.

Where a task begins in the middle of a file, it cannot know whether a signature there starts a packet or is payload:
that hangs on all that came before. But the walk from packet to packet can only enter a range at one of its first bytes,
one packet's worth. So every range is first walked from all of these entries at once, backwards over its signatures, which
says where each walk leaves it and how many packets and skipped bytes it met. Chaining these small tables, range after range,
gives each range its true entry, and then all ranges are decoded at once: rows and counts are those of one walk.
"""

from __future__ import annotations

import struct
import urllib.parse
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recordings import FILE_END, FILE_START, PACKET, SYNC, V2_HEADER, V2_PACKET, V2_SYNC

SIZE = V2_PACKET.itemsize
LEAST_LEFT = 8  # a packet's own header: with fewer bytes left the walk ends

ReadAt = Callable[[int, int], bytes]


def opened(path: str) -> ReadAt:
    """Range reads of a file in any store that pyarrow knows; a read past the end is short."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" or not colon:
        system, name = fs.LocalFileSystem(), urllib.parse.unquote("/" + rest.lstrip("/")) if colon else path
    else:
        system, name = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    file = system.open_input_file(name)
    return lambda at, n: file.read_at(n, at)


def first_packet(read_at: ReadAt) -> int:
    """Where packets begin."""
    head = read_at(0, struct.calcsize(V2_SYNC) + struct.calcsize(V2_HEADER))
    at = struct.calcsize(V2_SYNC) if head[:2] == struct.pack("<H", SYNC) else 0
    if len(head) < at + struct.calcsize(V2_HEADER):
        raise ValueError("file too small for a header")
    fields = struct.unpack_from(V2_HEADER, head, at)
    if fields[0] != FILE_START or fields[-1] != FILE_END:
        raise ValueError("wrong signature in the file header")
    return at + struct.calcsize(V2_HEADER)


def signatures(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    low, high = struct.pack("<H", PACKET)
    return np.flatnonzero((raw[:-1] == low) & (raw[1:] == high)) if len(raw) > 1 else np.empty(0, np.int64)


def walks(data: bytes, stop: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries 0..SIZE-1 of a range of `stop` bytes: where the walk leaves it, its packets, its skipped bytes.

    data holds the range and, but for the last range of a file, a packet's length beyond it. The last range is left where the walk ends.
    """
    end = max(stop - LEAST_LEFT + 1, 0) if last else stop  # no packet begins from here on
    marks = signatures(data)
    marks = marks[marks < end]
    n = len(marks)
    after = np.searchsorted(marks, marks + SIZE)
    leaves, packets, skipped = (np.empty(n + 1, np.int64) for _ in range(3))
    leaves[n], packets[n], skipped[n] = end, 0, 0
    for i in range(n - 1, -1, -1):
        at = marks[i] + SIZE
        if last and at > stop:  # cut off: the walk ends before it
            leaves[i], packets[i], skipped[i] = marks[i], 0, 0
            continue
        j = after[i]
        gap = (marks[j] if j < n else max(end, at)) - at
        leaves[i] = leaves[j] if j < n else max(end, at)
        packets[i], skipped[i] = packets[j] + 1, skipped[j] + gap
    entry = np.arange(SIZE)
    j = np.searchsorted(marks, entry)
    gap = np.where(j < n, marks[np.minimum(j, max(n - 1, 0))] if n else 0, np.maximum(end, entry)) - entry
    return np.where(j < n, leaves[j], np.maximum(end, entry)), packets[j], skipped[j] + gap


def ranges_of(files: DataFrame, split: int) -> DataFrame:
    """rec, part, start, stop, last: each file's packets in ranges of some `split` bytes; files that are no such recordings give none."""
    split = max(split, 2 * SIZE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rec, length in zip(batch["rec"], batch["length"], strict=True):
                try:
                    first = first_packet(opened(rec))
                except (ValueError, struct.error):
                    continue
                n = max(1, (length - first) // split)
                start = first + split * np.arange(n)
                for at in range(0, n, 10_000):
                    part = np.arange(at, min(at + 10_000, n))
                    yield pd.DataFrame({"rec": rec, "part": part, "start": start[part], "stop": np.append(start[1:], max(length, first))[part], "last": part == n - 1})

    return files.mapInPandas(run, "rec string, part long, start long, stop long, last boolean")


def entered(ranges: DataFrame) -> DataFrame:
    """ranges with entry (bytes from start), packets and skipped (of the true walk), before (packets of earlier ranges) and ended (where a last range's walk ends).

    A file's ranges are chained in one task: a table of SIZE entries each, a thousandth of the file or less.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                size = r.stop - r.start
                leaves, packets, skipped = walks(opened(r.rec)(r.start, size + (0 if r.last else 1)), size, r.last)
                rows.append((leaves.astype(np.int64).tolist(), packets.tolist(), skipped.tolist()))
            yield batch.assign(leaves=[x[0] for x in rows], packets=[x[1] for x in rows], skipped=[x[2] for x in rows])

    def chain(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, before = 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                leaves = r["leaves"][entry]
                out.append((r["rec"], r["part"], r["start"], r["stop"], r["last"], entry, r["packets"][entry], r["skipped"][entry], before, r["start"] + leaves if r["last"] else None))
                before += r["packets"][entry]
                entry = leaves - (r["stop"] - r["start"])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wanted, strict=True)], schema=wanted)

    wanted = pa.schema([("rec", pa.string()), ("part", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("last", pa.bool_()), ("entry", pa.int64()), ("packets", pa.int64()), ("skipped", pa.int64()), ("before", pa.int64()), ("ended", pa.int64())])
    base = "rec string, part long, start long, stop long, last boolean"
    walked = ranges.mapInPandas(walk, base + ", leaves array<long>, packets array<long>, skipped array<long>")
    out = base + ", entry long, packets long, skipped long, before long, ended long"

    def chained(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(chain(None, table.sort_by("part").to_batches(64))), wanted)

    return walked.groupBy("rec").applyInArrow(chained, out)


def v2_files(spark: SparkSession, path: str) -> DataFrame:
    """rec and length of all files; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("rec"), "length")


def spread(ranges: DataFrame) -> DataFrame:
    """A range, or a few, to a task."""
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "rec", "part")


def v2_counts(spark: SparkSession, path: str, split: int = 8 << 20) -> DataFrame:
    """rec, packets_found, corrupted_skipped, bytes_read, n_samples of each second-format file, as read_recordings has them."""
    got = entered(spread(ranges_of(v2_files(spark, path), split)))
    return got.groupBy("rec").agg(F.sum("packets").alias("packets_found"), F.sum("skipped").alias("corrupted_skipped"), F.max("ended").alias("bytes_read"), (64 * F.sum("packets")).alias("n_samples"))


def v2_samples(spark: SparkSession, path: str, split: int = 8 << 20, packets_at_once: int = 500) -> DataFrame:
    """The rows of read_samples for second-format files, each file read by as many tasks as it has ranges."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = r.start + r.entry
                data = opened(r.rec)(at, r.stop - at + (0 if r.last else SIZE))
                end = (r.stop - at - LEAST_LEFT + 1) if r.last else r.stop - at
                marks, pos, found = signatures(data), 0, []
                i = np.searchsorted(marks, pos)
                while i < len(marks) and marks[i] < end and marks[i] + SIZE <= len(data):
                    found.append(marks[i])
                    i = np.searchsorted(marks, marks[i] + SIZE)
                raw = np.frombuffer(data, np.uint8)
                for k in range(0, len(found), packets_at_once):
                    some = np.array(found[k : k + packets_at_once])
                    packets = raw[some[:, None] + np.arange(SIZE)].copy().view(V2_PACKET).ravel()
                    n = 64 * len(packets)
                    imu = np.full(n, None, object)
                    imu[::8] = list(packets["imu"].reshape(-1, 10).tolist())
                    idx = 64 * (r.before + k) + np.arange(n)
                    yield pd.DataFrame({"rec": r.rec, "idx": idx, "piezo": packets["piezo"].reshape(-1, 2).tolist(), "imu": imu, "press": np.repeat(packets["flags"] & 1, 64).astype(np.int8)})

    placed = spread(entered(spread(ranges_of(v2_files(spark, path), split))))
    rows = placed.mapInPandas(decode, "rec string, idx long, piezo array<int>, imu array<int>, press tinyint")
    return rows.select("rec", "idx", "piezo", F.lit(None).cast("array<int>").alias("accel"), "imu", F.lit(None).cast("int").alias("force"), "press")
