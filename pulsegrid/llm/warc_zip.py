"""Web archives packed in ZIP files: written by Spark's own writer, read by byte ranges and never extracted.

A package is a ZIP file with two stored members, `archive/data.warc.gz` (one gzip member a record) and
`indexes/index.cdx` (a line for each record: where it starts and how long it is). Each task writes one. The bytes go
through Spark's text writer, so they reach any file system that Spark does and a lost task leaves nothing behind: that
writer ends each row by a line feed, so the stream is cut where it holds one anyway, and the ZIP comment, which comes
last, is a line feed.

Reading starts at the end of a package: the end record, its ZIP64 form if there is one, and the central directory say
where members are; indexes say where records are in them; adjacent records are read together, spread over tasks by place.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions

# Fixed values of the ZIP format: signatures, and the layouts of the records that they begin.
LOCAL, LOCAL_AT = b"PK\x03\x04", "<4s5H3L2H"
DESCRIPTOR, DESCRIPTOR64_AT = b"PK\x07\x08", "<4sLQQ"
CENTRAL, CENTRAL_AT = b"PK\x01\x02", "<4s6H3L5H2L"
END, END_AT = b"PK\x05\x06", "<4s4H2LH"
END64, END64_AT = b"PK\x06\x06", "<4sQ2H2L4Q"
LOCATOR64, LOCATOR64_AT = b"PK\x06\x07", "<4sLQL"
width = struct.calcsize
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
EXTRA64 = 1
STORED, VERSION, FIRST_DAY = 0, 45, 0x21
WITH_DESCRIPTOR, ENCRYPTED = 1 << 3, 1

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes read at once: of directories and indexes, of records that lie side by side.
BLOCK = 1 << 20
SPAN = 8 << 20

ReadAt = Callable[[int, int], bytes]


def base32_sha1(column: Column) -> Column:
    """Upper-case base 32 of a binary column's SHA-1: eight digits for every five bytes."""
    digest = F.sha1(column)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# Writing


class Package:
    """One ZIP file in the making: members are stored as they come, sizes follow them, the directory ends the file.

    limit: numbers from here on go to ZIP64 fields; FULL32 is the format's own.
    """

    def __init__(self, limit: int = FULL32):
        self.out, self.at, self.limit = bytearray(), 0, limit
        self.members: list[tuple[bytes, int, int, int]] = []  # name, where its header is, CRC, size

    def put(self, data: bytes) -> None:
        self.out += data
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header_at, self.crc, self.size = name.encode(), self.at, 0, 0
        self.put(struct.pack(LOCAL_AT, LOCAL, VERSION, WITH_DESCRIPTOR, STORED, 0, FIRST_DAY, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<2H2Q", EXTRA64, 16, 0, 0))

    def data(self, data: bytes) -> None:
        self.put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def finish(self) -> None:
        self.put(struct.pack(DESCRIPTOR64_AT, DESCRIPTOR, self.crc, self.size, self.size))
        self.members.append((self.name, self.header_at, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, header_at, crc, size in self.members:
            large = [size, size] * (size >= self.limit) + [header_at] * (header_at >= self.limit)
            extra = struct.pack(f"<2H{len(large)}Q", EXTRA64, 8 * len(large), *large) if large else b""
            size, header_at = (x if x < self.limit else FULL32 for x in (size, header_at))
            self.put(struct.pack(CENTRAL_AT, CENTRAL, VERSION, VERSION, WITH_DESCRIPTOR, STORED, 0, FIRST_DAY, crc, size, size, len(name), len(extra), 0, 0, 0, 0, header_at) + name + extra)
        n, size, end = len(self.members), self.at - start, self.at
        if start >= self.limit:
            self.put(struct.pack(END64_AT, END64, width(END64_AT) - 12, VERSION, VERSION, 0, 0, n, n, size, start) + struct.pack(LOCATOR64_AT, LOCATOR64, 0, end, 1))
            start = FULL32
        self.put(struct.pack(END_AT, END, 0, 0, n, n, size, start, 1) + b"\n")

    def row(self) -> bytes | None:
        """What there is up to the last line feed, without it."""
        cut = self.out.rfind(b"\n")
        if cut < 0:
            return None
        row = bytes(self.out[:cut])
        del self.out[: cut + 1]
        return row


def uri(url: str | None) -> str:
    """A url as a header takes it: other than printable ASCII is per cent encoded."""
    return "about:blank" if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def urn(hexes: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hexes[:32])}>"


def warc_record(kind: str, record: str, date: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", urn(record)), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def packages(date: str, level: int, limit: int):
    """Kernel: rows of `captures` to the rows of one package's text."""

    def deflated(data: bytes) -> bytes:
        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
        return gz.compress(data) + gz.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, index = Package(limit), bytearray()

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            if len(package.out) >= least and (row := package.row()) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["piece"])

        for batch in batches:
            payloads = batch.column("payload")
            small = batch.select(["page_id", "url", "record", "digest", "first_record", "first_url"]).to_pylist()
            for i, r in enumerate(small):
                if not package.at:
                    package.begin(ARCHIVE)
                    package.data(deflated(warc_record("warcinfo", hashlib.sha256(r["record"].encode()).hexdigest(), date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                target = uri(r["url"])
                fields = [("WARC-Target-URI", target), ("WARC-Page-ID", r["page_id"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                kind, block = "response", b""
                if r["first_record"] is not None:
                    kind = "revisit"
                    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", urn(r["first_record"])), ("WARC-Refers-To-Target-URI", uri(r["first_url"])), ("WARC-Refers-To-Date", date)]
                else:
                    payload = payloads[i].as_buffer().to_pybytes()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    fields.append(("Content-Type", "application/http; msgtype=response"))
                at, data = package.size, deflated(warc_record(kind, r["record"], date, fields, block))
                package.data(data)
                entry = {"url": target, "recordType": kind, "digest": f"sha1:{r['digest']}", "filename": ARCHIVE.rpartition("/")[2], "offset": str(at), "length": str(len(data))}
                index += f"{target} {''.join(c for c in date if c.isdigit())} {json.dumps(entry)}\n".encode()
                yield from rows(BLOCK)
        if package.at:
            package.finish()
            package.begin(INDEX)
            for at in range(0, len(index), BLOCK):
                package.data(bytes(index[at : at + BLOCK]))
                yield from rows(BLOCK)
            package.finish()
            package.close()
            yield from rows(0)

    return run


def captures(pages: DataFrame, keep: Scratch, id_col: str, url_col: str, body_col: str, least_bytes: int) -> DataFrame:
    """One row a record: page_id, url, record, digest, payload (null for revisits), first_record and first_url (of the response; null for responses).

    Payloads of at least least_bytes that are equal (SHA-1 and length) are one response, that of the least page_id
    (then of the least url; nulls last), which the others refer to. Only distinct payloads are shuffled, copies meet as ids.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), body.alias("payload"))
    key, payload = ["digest", "bytes"], ["page_id", "order", "url"]
    first = F.min(F.struct(F.col("order").isNull().alias("no_id"), "order", F.col("url").isNull().alias("no_url"), "url", "page_id"))

    def record(page_id: str, url: str, copy: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.coalesce(page_id, F.lit("-")), F.coalesce(url, F.lit("-")), "digest", copy.cast("string")), 256)

    facts = keep(rows.groupBy(*payload, *key).agg(F.count("*").alias("n")))
    large = F.col("bytes") >= least_bytes
    shared = facts.where(large).groupBy(*key).agg(first.alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    met = facts.where(large).join(shared, key).select(*payload, *key, "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    later = met.withColumn("from", is_first.cast("long")).where("n > from").withColumn("copy", F.explode(F.sequence("from", F.col("n") - 1)))
    revisits = later.select("page_id", "url", record("page_id", "url", F.col("copy")).alias("record"), "digest", F.lit(None).cast("binary").alias("payload"), record("first_id", "first_url", F.lit(0)).alias("first_record"), "first_url")

    def responses(of: DataFrame, copy: Column) -> DataFrame:
        return of.select("page_id", "url", record("page_id", "url", copy).alias("record"), "digest", "payload", F.lit(None).cast("string").alias("first_record"), F.lit(None).cast("string").alias("first_url"))

    ones = rows.where(large).groupBy(*key).agg(first.alias("first"), F.first("payload").alias("payload")).select("first.page_id", "first.url", "digest", "payload")
    out = responses(ones, F.lit(0)).union(revisits)
    if least_bytes > 0:  # each small payload is a response of its own; the copy's number need only tell records apart
        out = out.union(responses(rows.where(~large), F.monotonically_increasing_id()))
    return out


def write_packages(pages: DataFrame, folder: str, keep: Scratch, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 4, limit: int = FULL32) -> None:
    """Writes a WARC record for each row to the ZIP packages in `folder`, one package a task.

    A null body is empty; a null url is about:blank; a null id has no WARC-Page-ID; repeated rows are records of their
    own; other columns are not read; an empty table writes no package. A task holds its package's index, some
    200 bytes a record, and one payload. Packages have Spark's file names.
    """
    rows = captures(pages, keep, id_col, url_col, body_col, least_bytes)
    rows.mapInArrow(packages(date, level, limit), "piece binary").select(F.col("piece").cast("string").alias("value")).write.text(folder)


# Reading


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    header_at: int
    size: int


def opened(path: str) -> tuple[ReadAt, int]:
    """Range reads of a file of any file system that pyarrow knows, and its length."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file":
        system, name = fs.LocalFileSystem(), urllib.parse.unquote("/" + rest.lstrip("/"))
    elif not colon:
        system, name = fs.LocalFileSystem(), path
    else:
        system, name = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    file = system.open_input_file(name)

    def read_at(at: int, n: int) -> bytes:
        data = file.read_at(n, at)
        if len(data) < n:
            raise ValueError(f"{path} ends at {at + len(data)}, before {at + n}")
        return data

    return read_at, file.size()


def members(read_at: ReadAt, length: int) -> Iterator[Member]:
    """The central directory of a ZIP file, read in blocks."""
    tail = read_at(length - (n := min(length, width(END_AT) + FULL16)), n)
    at = tail.rfind(END)
    while at >= 0 and (at + width(END_AT) > n or at + width(END_AT) + struct.unpack_from(END_AT, tail, at)[7] != n):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP file: it has no end record")
    _, _, _, _, count, size, start, _ = struct.unpack_from(END_AT, tail, at)
    stop = length - n + at
    if FULL16 == count or FULL32 in (size, start):
        if stop >= width(LOCATOR64_AT) and (locator := read_at(stop - width(LOCATOR64_AT), width(LOCATOR64_AT)))[:4] == LOCATOR64:
            end64 = struct.unpack(LOCATOR64_AT, locator)[2]
            found = struct.unpack(END64_AT, read_at(end64, width(END64_AT)))
            if found[0] != END64:
                raise ValueError("the ZIP64 locator leads to no end record")
            count, size, start, stop = *found[7:10], end64
    base = stop - size - start  # bytes before the first member, as in files that run themselves
    at, data = base + start, b""
    for _ in range(count):
        while at < stop and len(data) < width(CENTRAL_AT) + 3 * FULL16:
            data += read_at(at, min(BLOCK, stop - at))
            at += min(BLOCK, stop - at)
        signature, _, _, flags, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, header_at = struct.unpack_from(CENTRAL_AT, data)
        if signature != CENTRAL:
            raise ValueError("the central directory is broken")
        name, extra = data[width(CENTRAL_AT) :][:n_name], data[width(CENTRAL_AT) + n_name :][:n_extra]
        data = data[width(CENTRAL_AT) + n_name + n_extra + n_comment :]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == EXTRA64:
                large = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size, packed, header_at = (next(large) if x == FULL32 else x for x in (size, packed, header_at))
            extra = extra[4 + n :]
        yield Member(name.decode("utf-8", "replace"), method, flags, base + header_at, packed)


def data_at(read_at: ReadAt, member: Member) -> int:
    """Where a stored member's data begin: its own header may be longer than the directory's."""
    if member.method != STORED or member.flags & ENCRYPTED:
        raise ValueError(f"{member.name} is not stored as it is, so it has no ranges")
    header = struct.unpack(LOCAL_AT, read_at(member.header_at, width(LOCAL_AT)))
    if header[0] != LOCAL:
        raise ValueError(f"no member begins where {member.name} should")
    return member.header_at + width(LOCAL_AT) + header[9] + header[10]


def lines(read_at: ReadAt, at: int, size: int) -> Iterator[bytes]:
    rest = b""
    for start in range(at, at + size, BLOCK):
        *whole, rest = (rest + read_at(start, min(BLOCK, at + size - start))).split(b"\n")
        yield from whole
    if rest:
        yield rest


def record_places(read_at: ReadAt, length: int) -> Iterator[tuple[int, int]]:
    """Where each record lies in a package, by its indexes; a WARC member that no index names is one place."""
    archives, indexes = {}, []
    for member in members(read_at, length):
        folder, _, name = member.name.rpartition("/")
        if folder == "archive" and name.endswith((".warc", ".warc.gz")):
            archives[name] = data_at(read_at, member), member.size
        elif folder == "indexes" and name.endswith((".cdx", ".cdxj")):
            indexes.append((data_at(read_at, member), member.size))
    named = set()
    for at, size in indexes:
        for line in lines(read_at, at, size):
            if b"{" in line:
                entry = json.loads(line[line.index(b"{") :])
                named.add(name := entry["filename"])
                yield archives[name][0] + int(entry["offset"]), int(entry["length"])
    for name in archives.keys() - named:
        yield archives[name]


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members in a row, or of blocks that are not compressed."""
    state, plain = None, None
    for block in blocks:
        plain = block[:2] != b"\x1f\x8b" if plain is None else plain
        while block:
            if plain:
                yield block
                break
            state = state or zlib.decompressobj(31)
            yield state.decompress(block, SPAN)
            block, state = (state.unused_data, None) if state.eof else (state.unconsumed_tail, state)
    if state is not None:
        raise ValueError("a place ends within a record")


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while need(1):
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not need(searched + 1):
                raise ValueError("a WARC header does not end")
        version, *fields = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        begin, size = end + 4, int(header["content-length"])
        if not need(begin + size + 4):
            raise ValueError("a WARC block does not end")
        yield header, bytes(held[begin : begin + size])
        del held[: begin + size + 4]


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header, if the block has one; it must have the digest that the record names."""
    payload = block.partition(b"\r\n\r\n")[2] if header.get("content-type", "").startswith("application/http") else block
    kind, _, named = header.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != named:
        raise ValueError(f"the payload of {header.get('warc-record-id')} has not the digest that it names")
    return payload


def spans(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Sorted places that touch, read together up to SPAN bytes."""
    start = stop = None
    for a, n in zip(at.tolist(), size.tolist(), strict=True):
        if stop is not None and a == stop and stop + n - start <= SPAN:
            stop += n
            continue
        if stop is not None:
            yield start, stop - start
        start, stop = a, a + n
    if stop is not None:
        yield start, stop - start


def read_packages(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row a record of the ZIP packages in `folder`: record_id, record_type, page_id, target_uri, refers_to, payload_digest, payload_bytes (null for revisits), and payload.

    Nothing is extracted and no file is read whole: directories and indexes are read where the packages are listed, records by
    range, dealt to tasks by package and place. A package that is broken, whose members are compressed, or whose
    payload has another digest than its record names, fails the job. Empty files are passed over.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = np.array(list(record_places(*opened(path))), np.int64).reshape(-1, 2)
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["path", "at", "size"])

    made = [("record_id", "string"), ("record_type", "string"), ("page_id", "string"), ("target_uri", "string"), ("refers_to", "string"), ("payload_digest", "string"), ("payload_bytes", "long")]
    made += [("payload", "binary")] * payloads
    names, types = [m[0] for m in made], [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[m[1]] for m in made]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path").to_pylist()
            at, size = (np.asarray(batch.column(c)) for c in ("at", "size"))
            borders = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
            for low, high in zip(borders, borders[1:], strict=False):
                if low == high:
                    continue
                read_at, _ = opened(path[low])
                for start, n in spans(at[low:high], size[low:high]):
                    blocks = (read_at(k, min(SPAN, start + n - k)) for k in range(start, start + n, SPAN))
                    rows, held = [], 0
                    for header, block in warc_records(inflated(blocks)):
                        payload = payload_of(header, block) if header["warc-type"] != "revisit" else None
                        row = [header.get(k) for k in ("warc-record-id", "warc-type", "warc-page-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")] + [None if payload is None else len(payload)]
                        rows.append(row + [payload] * payloads)
                        held += len(block)
                        if held > SPAN:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    listed = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0").select("path")
    found = listed.mapInArrow(places, "path string, at long, size long")
    dealt = found.repartition(partitions(spark), "path", F.floor(F.col("at") / SPAN)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(fetch, T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in made)))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare), record_type, refers_to (page_id of the response that a revisit names), target_uri.

    A revisit takes its length from the response; one whose response is not there has null. records should be written down.
    """
    bare = F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest")
    there = records.where("record_type = 'response'")
    named = there.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"))
    revisits = records.where("record_type = 'revisit'").join(named, "refers_to", "left")
    nobody = F.lit(None).cast("string").alias("refers_to")
    responses = there.select("page_id", "payload_bytes", bare, "record_type", nobody, "target_uri")
    return responses.union(revisits.select("page_id", F.col("to_bytes"), bare, "record_type", F.col("to_page"), "target_uri"))
