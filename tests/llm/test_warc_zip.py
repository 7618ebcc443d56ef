"""ZIP-packaged web archives: against plain ZIP and gzip readers, and back."""

import base64
import gzip
import hashlib
import io
import random
import zipfile
from collections import Counter

import pytest

from pulsegrid.llm import warc_zip as wz
from pulsegrid.llm.common import Scratch

ROW = "page_id long, url string, html string, payload string, digest string, n string"


def pages(spark, rows):
    """Rows with columns whose names clash with names inside."""
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROW)


def round_trip(spark, rows, folder, **how):
    with Scratch(spark) as keep:
        wz.write_packages(pages(spark, rows), folder, keep, **how)
    return wz.read_packages(spark, folder, payloads=True)


def files(folder):
    return [f for f in sorted(folder.iterdir()) if f.name.startswith("part-") and f.stat().st_size]


def expected(rows, least=0):
    """Rows of one id must not be there twice."""
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first[html or ""] if len(data) >= least else i
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else str(to)))
    return sorted(out)


ROWS = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://a b/\r\nX: y", ""), (4, "u", "x" * 300_000), (5, "u", "<p>é</p>"), (9, "v", "\r\n\r\nWARC/1.1\r\n"), (7, "w", "x" * 300_000), (-2, "z", "\n"), (8, "", "PK\x05\x06" * 9)]


@pytest.mark.parametrize(("least", "limit"), [(0, wz.FULL32), (3, 100), (10**6, 1)])
def test_round_trip(spark, tmp_path, least, limit):
    records = round_trip(spark, ROWS, str(tmp_path / "p"), least_bytes=least, limit=limit)
    got = [tuple(r)[:5] for r in wz.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got) == expected(ROWS, least)
    held = {r.page_id: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert all(held[str(i)] == (html or "").encode() for i, _, html in ROWS if str(i) in held)
    assert {r.target_uri for r in records.collect()} >= {"http://a%20b/%0D%0AX:%20y", "about:blank"}


@pytest.mark.parametrize("limit", [wz.FULL32, 50])
def test_packages_are_plain_zip_and_gzip_files(spark, tmp_path, limit):
    round_trip(spark, ROWS, str(tmp_path / "p"), limit=limit)
    kinds = Counter()
    for file in files(tmp_path / "p"):
        with zipfile.ZipFile(file) as package:
            assert package.testzip() is None and package.namelist() == [wz.ARCHIVE, wz.INDEX]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
            data = gzip.decompress(package.read(wz.ARCHIVE))
            kinds.update(h["warc-type"] for h, _ in wz.warc_records(iter([data])))
            assert len(package.read(wz.INDEX).splitlines()) == sum(1 for h, _ in wz.warc_records(iter([data])) if h["warc-type"] != "warcinfo")
    assert kinds["response"] == 6 and kinds["revisit"] == 3 and kinds["warcinfo"] == len(files(tmp_path / "p"))


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_reads_packages_that_others_make(spark, tmp_path, monkeypatch, block):
    """Other members, a prefix, a comment that looks like an end record, compressed extras, an archive without an index, plain WARC."""
    one = wz.warc_record("response", "0" * 32, "d", [("WARC-Page-ID", "1")], b"one")
    two = wz.warc_record("resource", "1" * 32, "d", [("WARC-Page-ID", "2")], b"two" * 99)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as package:
        package.writestr("pages/pages.jsonl", "{}\n" * 50, zipfile.ZIP_DEFLATED)
        for k in range(40):
            package.writestr(f"fuzzy/{k}", b"")
        package.writestr("archive/plain.warc", one + two)
        package.writestr("archive/other.warc.gz", gzip.compress(one) + gzip.compress(two))
        package.comment = b"see PK\x05\x06 and more than that follows it here"
    (tmp_path / "a.wacz").write_bytes(b"#!/bin/sh\n" + held.getvalue())
    monkeypatch.setattr(wz, "BLOCK", block)
    read_at, length = wz.opened(str(tmp_path / "a.wacz"))
    found = list(wz.members(read_at, length))
    assert [m.name for m in found] == ["pages/pages.jsonl", *(f"fuzzy/{k}" for k in range(40)), "archive/plain.warc", "archive/other.warc.gz"]
    got = wz.read_packages(spark, str(tmp_path), payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [("1", b"one"), ("1", b"one"), ("2", b"two" * 99), ("2", b"two" * 99)]


def test_only_ranges_are_read(tmp_path):
    held = io.BytesIO()
    body = random.Random(1).randbytes(3 << 20)
    with zipfile.ZipFile(held, "w") as package:
        package.writestr("archive/big.warc.gz", body)
        package.writestr("indexes/index.cdx", 'x 2000 {"filename": "big.warc.gz", "offset": "1000", "length": "10"}\n')
    data, read = held.getvalue(), []

    def read_at(at, n):
        read.append(n)
        return data[at : at + n]

    assert [n for _, n in wz.record_places(read_at, len(data))] == [10]
    assert sum(read) < 200_000


def broken(data, at, value):
    return data[:at] + value + data[at + len(value) :]


def test_broken_packages_are_refused(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("archive/data.warc", b"x" * 1000)
    data = held.getvalue()

    def places(data):
        return list(wz.record_places(lambda at, n: data[at : at + n], len(data)))

    with pytest.raises(ValueError, match="not stored"):
        places(data)
    with pytest.raises(ValueError, match="no end record"):
        places(b"no archive at all")
    with pytest.raises(ValueError, match="directory is broken"):
        places(broken(data, data.rindex(wz.CENTRAL), b"xx"))
    with pytest.raises(ValueError, match="does not end"):
        list(wz.warc_records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    with pytest.raises(ValueError, match="within a record"):
        list(wz.inflated(iter([gzip.compress(b"x" * 100)[:-5]])))
    with pytest.raises(ValueError, match="has not the digest"):
        wz.payload_of({"warc-payload-digest": "sha1:AAAA"}, b"x")


def test_edges(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "none")).count() == 0
    rows = [(None, None, "a"), (None, None, "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (3, "t", "b"), (None, "u", "b"), (None, None, None)]
    records = round_trip(spark, rows, str(tmp_path / "nulls"))
    assert records.select("record_id").distinct().count() == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in wz.resolved(records).collect())
    assert got == Counter([(None, 1, "response", None), (None, 1, "revisit", None), (None, 1, "revisit", None), ("3", 1, "response", None), ("3", 1, "revisit", "3"), ("3", 1, "revisit", "3"), (None, 1, "revisit", "3"), (None, 0, "response", None)])
    first = records.where("page_id = '3' AND record_type = 'response'").first()
    assert first.target_uri == "t"


def test_long_rows_are_cut_at_line_feeds():
    package = wz.Package()
    package.begin(wz.ARCHIVE)
    assert package.row() is None or b"\n" not in package.out
    package.data(b"ab\ncd\nef")
    assert package.row().endswith(b"ab\ncd") and package.out == b"ef"
    package.finish()
    package.close()
    package.row()
    assert not package.out
