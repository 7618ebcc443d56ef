"""Fill-in-the-middle against a version that cuts one text at a time."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import fill_in_middle as fim

ROW = "doc_id long, text string, n string, form string, h1 string, output string"
EDGE = [None, "", " ", "\n\t ", "one", " one", "one ", "é ü ñ", "a<P>b c d e", "<M>", "x<S", "> y z <P", "a b c d", "𝄞 𝄞𝄞 x", "w " * 5000, "same same", "same same"]


def one(i, text, rate=50, spm=80, seed=42):
    text = text or ""
    w = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(w), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in zip(ids or range(len(texts)), texts, strict=True)], ROW)


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 50), (0, 80)])
def test_matches_one_at_a_time(spark, rate, spm):
    rng = random.Random(rate)
    texts = EDGE + ["".join(rng.choice(["a", "bc", "é", " ", "\n", "\t", "漢", "<", "P>", "S", "𝄞"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    out = fim.fill_in_middle(rows(spark, texts), rate=rate, spm=spm).withColumn("again", fim.restored("output", "form"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == one(i, text, rate, spm), text
        assert got[i].again == (text or "")
    assert rate == 0 or {r.form for r in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("most", [1, 7, 64])
def test_portions_and_slices_change_nothing(most):
    texts = EDGE + ["a b c d", "", "e  f g", None, "h"]
    column = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
    data, start, end = fim.flat(column)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == [t or "" for t in texts]
    cut = list(fim.portions(start, end, most))
    assert [c[0] for c in cut] == [0] + [c[1] for c in cut[:-1]] and cut[-1][1] == len(texts)
    assert all(high - low == 1 or end[high - 1] - start[low] <= most for low, high in cut)


def test_null_rows_that_hide_bytes():
    offsets, data = pa.array([0, 3, 6, 9], pa.int32()).buffers()[1], pa.py_buffer(b"a bxyzc d")
    column = pa.StringArray.from_buffers(3, offsets, data, pa.py_buffer(bytes([0b101])), 1)
    data, start, end = fim.flat(column)
    h = [fim.np.full(3, 5)] * 4
    got = fim.rearranged(data, start, end, h, 100, 0)
    assert got["n"].tolist() == [2, 0, 2] and got["form"].tolist() == [1, 0, 1]


def test_edges(spark):
    got = fim.fill_in_middle(rows(spark, ["a b c", "a b c", "a b c", None], [3, 3, None, None]), rate=100).collect()
    assert sorted(((r.doc_id or -1, *one(r.doc_id, "a b c" if r.n else "", 100)) for r in got), key=str) == sorted(((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str)
    assert fim.fill_in_middle(rows(spark, [])).count() == 0
    kept = fim.fill_in_middle(rows(spark, ["a b"]).withColumn("lang", F.lit("xx")), keep=("lang",)).first()
    assert kept.lang == "xx" and kept.asDict().keys() == {"doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"}
