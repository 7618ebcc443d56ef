"""Binary recordings to DataFrames: format sniffing, two readers, a synthetic writer.

Files come through Spark's own binaryFile source, so that any store it reads will do; a file is one row and one
task, and is decoded there to a row per sample with null where a channel has no value. Corrupt files give an error
row in `recordings` and no samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the two formats.
FILE_START, FILE_END, FILE_TRAILER = 0x48414148, 0x485A5A48, 0x445A5A44
SYNC, PACKET = 0xA55E, 0x504B
LAST_V1_TIME = 4102444800
V1_HEADER = "<LHLHHHHH"
V1_PARTS = ((0x80, 8), (0x40, 12), (0x20, 20), (0x10, 2), (0x08, 6))  # piezo, accelerometer, IMU, force, time
V2_SYNC = "<HLLLB"
V2_HEADER = "<LLHLHHHHHLHL4s6sL"
V2_PACKET = np.dtype([("sig", "<u2"), ("seq", "u1"), ("ms", "<u4"), ("flags", "u1"), ("piezo", "<u2", (64, 2)), ("imu", "<i2", (8, 10))])

SAMPLE_SCHEMA = "rec string, idx long, piezo array<int>, accel array<int>, imu array<int>, force int, press tinyint"
RECORDING_SCHEMA = "rec string, file_format string, start_ms long, end_ms long, freq_piezo int, freq_accel int, freq_imu int, freq_force int, last_sync_ms long, device_id string, mac string, n_samples long, packets_found long, corrupted_skipped long, bytes_read long, error string"


def file_format(content: Column) -> Column:
    """'v1', 'v2' or 'unknown' by the first four bytes, little-endian."""
    head = F.hex(F.substring(content, 1, 4))
    value = F.conv(F.concat(*(F.substring(head, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")
    return F.when(F.octet_length(content) < 4, "unknown").when((head == "48414148") | head.startswith("5EA5"), "v2").when(value <= LAST_V1_TIME, "v1").otherwise("unknown")


def v1_offsets(data: bytes) -> tuple[np.ndarray, int]:
    """Start of every whole record, and where the walk ended. A record's length hangs on its own flags."""
    sizes = [1 + sum(n for bit, n in V1_PARTS if d & bit) for d in range(256)]
    at, pos, end = [], struct.calcsize(V1_HEADER), len(data)
    while pos < end:
        after = pos + sizes[data[pos]]
        if after > end:
            break
        at.append(pos)
        pos = after
    return np.array(at, np.int64), pos


def parse_v1(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and channels; a channel is (index of its records, values)."""
    if len(data) < struct.calcsize(V1_HEADER):
        raise ValueError("file too small for a header")
    s, sm, e, em, *freq = struct.unpack_from(V1_HEADER, data)
    at, end = v1_offsets(data)
    buf = np.frombuffer(data, np.uint8)
    flags, place, channels = buf[at], at + 1, {}
    for name, (bit, size) in zip(("piezo", "accel", "imu", "force", "time"), V1_PARTS, strict=True):
        on = np.flatnonzero(flags & bit)
        raw = buf[place[on][:, None] + np.arange(size)]
        channels[name] = (on, np.ascontiguousarray(raw).view("<i2" if name == "imu" else "<u2"))
        place = place + np.where(flags & bit, size, 0)
    channels["press"] = (np.arange(len(at)), (flags & 1).astype(np.int8)[:, None])
    header = {"file_format": "v1", "start_ms": s * 1000 + sm, "end_ms": e * 1000 + em, "freq": freq, "n_samples": len(at), "packets_found": len(at), "corrupted_skipped": 0, "bytes_read": end}
    return header, channels


def parse_v2(data: bytes, start_byte: int = -1, end_byte: int = -1, max_packets: int = -1) -> tuple[dict, dict[str, np.ndarray]]:
    """As parse_v1. A packet without its signature is resynchronised byte by byte; an incomplete last one is dropped."""
    if len(data) < struct.calcsize(V2_HEADER):
        raise ValueError("file too small for a header")
    pos = struct.calcsize(V2_SYNC) if struct.unpack_from("<H", data)[0] == SYNC else 0
    first, s, sm, e, em, p, a, i, f, ls, lsm, _, device, mac, last = struct.unpack_from(V2_HEADER, data, pos)
    if first != FILE_START or last != FILE_END:
        raise ValueError("wrong signature in the file header")
    pos = max(pos + struct.calcsize(V2_HEADER), start_byte)
    end = end_byte if 0 < end_byte < len(data) else len(data)
    mark, at, skipped = struct.pack("<H", PACKET), [], 0
    while pos + 8 <= end and (max_packets < 0 or len(at) < max_packets):
        if data[pos : pos + 2] == mark:
            if pos + V2_PACKET.itemsize > end:
                break
            at.append(pos)
            pos += V2_PACKET.itemsize
        else:
            to = data.find(mark, pos + 1, end)
            to = min(to if to >= 0 else end, end - 7)
            skipped += max(to, pos + 1) - pos
            pos = max(to, pos + 1)
    raw = np.frombuffer(data, np.uint8)
    packets = raw[np.array(at, np.int64)[:, None] + np.arange(V2_PACKET.itemsize)].copy().view(V2_PACKET).ravel() if at else np.empty(0, V2_PACKET)
    n = 64 * len(packets)
    channels = {"piezo": (np.arange(n), packets["piezo"].reshape(-1, 2)), "imu": (np.arange(0, n, 8), packets["imu"].reshape(-1, 10)), "press": (np.arange(n), np.repeat(packets["flags"] & 1, 64).astype(np.int8)[:, None])}
    header = {"file_format": "v2", "start_ms": s * 1000 + sm, "end_ms": e * 1000 + em, "freq": (p, a, i, f), "last_sync_ms": ls * 1000 + lsm, "device_id": device.rstrip(b"\0").decode("latin-1"), "mac": mac.hex(), "n_samples": n, "packets_found": len(at), "corrupted_skipped": skipped, "bytes_read": pos}
    return header, channels


def parse(data: bytes, kind: str) -> tuple[dict, dict]:
    if kind not in ("v1", "v2"):
        raise ValueError("unknown file format")
    return parse_v2(data) if kind == "v2" else parse_v1(data)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(rec, kind, content): rec is the file's path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("rec"), file_format(F.col("content")).alias("kind"), "content")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """A row per file with its header and the reader's counts, or its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = dict(c.split() for c in RECORDING_SCHEMA.split(", "))
        for batch in batches:
            rows = []
            for rec, kind, content in zip(batch["rec"], batch["kind"], batch["content"], strict=True):
                row = {"rec": rec, "file_format": kind}
                try:
                    header, _ = parse(bytes(content), kind)
                    row |= {k: v for k, v in header.items() if k != "freq"} | dict(zip(("freq_piezo", "freq_accel", "freq_imu", "freq_force"), header["freq"], strict=True))
                except (ValueError, struct.error) as problem:
                    row["error"] = str(problem)
                rows.append(row)
            yield pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype="object" if kind == "string" else "Int64") for name, kind in kinds.items()})

    return files(spark, path).mapInPandas(run, RECORDING_SCHEMA)


def read_samples(spark: SparkSession, path: str, rows_at_once: int = 50_000) -> DataFrame:
    """A row per sample, channels null where they have no value. Files that cannot be read give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rec, kind, content in zip(batch["rec"], batch["kind"], batch["content"], strict=True):
                try:
                    header, channels = parse(bytes(content), kind)
                except (ValueError, struct.error):
                    continue
                for a in range(0, header["n_samples"], rows_at_once):
                    b = min(a + rows_at_once, header["n_samples"])
                    out = pd.DataFrame({"rec": rec, "idx": np.arange(a, b)})
                    for name in ("piezo", "accel", "imu", "force", "press"):
                        column = np.full(b - a, None, object)
                        if name in channels:
                            on, values = channels[name]
                            lo, hi = np.searchsorted(on, (a, b))
                            for i, v in zip((on[lo:hi] - a).tolist(), values[lo:hi].tolist(), strict=True):
                                column[i] = v if name not in ("force", "press") else v[0]
                        out[name] = column
                    yield out

    return files(spark, path).mapInPandas(run, SAMPLE_SCHEMA)


def write_v2(path: str, packets: int, sync: bool = False, garbage: dict[int, bytes] | None = None, cut: int = 0) -> None:
    """A synthetic file: sine and cosine piezo channels, constant IMU. garbage: bytes put before packet i; cut: bytes taken off the end."""
    n = np.arange(64 * packets)
    body = np.zeros(packets, V2_PACKET)
    body["sig"], body["seq"], body["ms"] = PACKET, np.arange(packets) % 256, 62 * np.arange(packets)
    body["piezo"] = np.stack([32768 + 20000 * np.sin(2 * np.pi * n / 1024), 32768 + 15000 * np.cos(2 * np.pi * n / 512)], 1).astype(np.uint16).reshape(packets, 64, 2)
    body["imu"] = np.array([10000, 0, 0, 0, 50, 60, 70, 0, 0, 9810])
    head = struct.pack(V2_HEADER, FILE_START, 1_700_000_000, 500, 1_700_000_000 + packets // 16, 500, 1024, 512, 128, 64, 1_700_000_000, 0, packets * V2_PACKET.itemsize, b"TEST", bytes(range(6)), FILE_END)
    out = (struct.pack(V2_SYNC, SYNC, 1, 2, 3, 4) if sync else b"") + head
    for i in range(packets):
        out += (garbage or {}).get(i, b"") + body[i].tobytes()
    out += struct.pack("<L", FILE_TRAILER)
    with open(path, "wb") as f:
        f.write(out[: len(out) - cut])


def write_v1(path: str, records: list[dict]) -> None:
    """records: dicts with any of piezo(4), accel(6), imu(10), force(1), time(3 u16) and press."""
    out = struct.pack(V1_HEADER, 1_600_000_000, 250, 1_600_000_010, 750, 1024, 512, 128, 64)
    for r in records:
        flags = sum(bit for name, (bit, _) in zip(("piezo", "accel", "imu", "force", "time"), V1_PARTS, strict=True) if name in r) | (1 if r.get("press") else 0)
        out += bytes([flags]) + b"".join(np.array(r[name], "<i2" if name == "imu" else "<u2").tobytes() for name in ("piezo", "accel", "imu", "force", "time") if name in r)
    with open(path, "wb") as f:
        f.write(out)
