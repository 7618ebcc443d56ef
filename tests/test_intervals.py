"""Interval operators against plain mask arithmetic on random masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals as iv
from pulsegrid.operators import maps, report


def runs(mask):
    d = np.diff(np.r_[0, np.asarray(mask, int), 0])
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def rows(df):
    return sorted((r.rec, r.start, r.end_excl) for r in df.select("rec", "start", "end_excl").collect())


def frame(spark, masks):
    return spark.createDataFrame([(i, a, b) for i, m in enumerate(masks) for a, b in runs(m)], "rec long, start long, end_excl long")


def expect(masks):
    return sorted((i, a, b) for i, m in enumerate(masks) for a, b in runs(m))


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(0)
    fixed = [np.zeros(60, bool), np.ones(60, bool), np.eye(60, dtype=bool)[0], np.eye(60, dtype=bool)[-1]]
    return [*(rng.random(n) < p for p in (0.02, 0.1, 0.4) for n in (50, 200, 500)), *fixed], [rng.random(n) < 0.1 for n in [50, 200, 500] * 3 + [60] * 4]


@pytest.fixture(scope="module")
def lengths(spark, masks):
    return spark.createDataFrame([(i, len(m)) for i, m in enumerate(masks[0])], "rec long, n long")


def dilated(mask, size):
    out, before = mask.copy(), size // 2
    for a, b in runs(mask):
        out[max(0, a - before) : b + size - before - 1] = True
    return out


@pytest.mark.parametrize("size", [0, 1, 4, 7])
def test_dilate_and_erode(spark, masks, lengths, size):
    a = frame(spark, masks[0])
    assert rows(iv.dilate(a.join(lengths, "rec"), size, F.col("n"))) == (expect([dilated(m, size) for m in masks[0]]) if size else expect(masks[0]))
    small = sorted((i, s + size // 2, e - (size - size // 2 - 1)) for i, m in enumerate(masks[0]) for s, e in runs(m) if e - s > size) if size else expect(masks[0])
    assert rows(iv.erode(a, size)) == small


def test_set_operations(spark, masks):
    x, y = masks
    a, b = frame(spark, x), frame(spark, y)
    assert rows(iv.union(a, b)) == expect([p | q for p, q in zip(x, y, strict=True)])
    assert rows(iv.intersect(a, b)) == expect([p & q for p, q in zip(x, y, strict=True)])
    assert rows(iv.subtract(a, b)) == expect([p & ~q for p, q in zip(x, y, strict=True)])
    semi = sorted((i, s, e) for i, m in enumerate(x) for s, e in runs(m) if y[i][s:e].any())
    for width in (None, 8):
        assert rows(iv.overlapping(a, b, "left_semi", width=width)) == semi
        assert rows(iv.overlapping(a, b, "left_anti", width=width)) == sorted(set(rows(a)) - set(semi))


def test_mask_round_trip(spark, masks, monkeypatch):
    monkeypatch.setattr(iv, "CHUNK", 16)
    s = spark.createDataFrame([(i, k, bool(v)) for i, m in enumerate(masks[0]) for k, v in enumerate(m)], "rec long, idx long, on boolean")
    a = iv.from_mask(s, F.col("on"))
    assert rows(a) == expect(masks[0])
    assert iv.to_mask(a).count() == sum(int(m.sum()) for m in masks[0])


def test_session_merge(spark, masks):
    def joined(mask, gap):
        out = mask.copy()
        r = runs(mask)
        for (_, b), (c, _) in zip(r, r[1:], strict=False):
            if c - (b - 1) <= gap:
                out[b:c] = True
        return out

    assert rows(iv.session_merge(frame(spark, masks[0]), 6)) == expect([joined(m, 6) for m in masks[0]])


def sequential_continuity(r, least, lapse, tolerance):
    """The fold told as a walk over runs."""
    kept, last, i = [], -lapse, 0
    while i < len(r):
        a, b = r[i]
        if b - a > least:
            kept.append((a, b))
        elif b - last > lapse:
            j = i
            while j + 1 < len(r) and r[j + 1][0] - r[j][1] <= tolerance:
                j += 1
            if r[j][1] - a > least:
                kept.append((a, r[j][1]))
                last = r[j][1]
            else:
                last = b
            i = j
        else:
            last = b
        i += 1
    return kept


def test_continuity(spark, masks):
    for least, lapse, tolerance in ((4, 3, 2), (6, 20, 5), (2, 0, 1)):
        want = sorted((i, a, b) for i, m in enumerate(masks[0]) for a, b in runs(m) and sequential_continuity(runs(m), least, lapse, tolerance))
        assert rows(iv.continuity(frame(spark, masks[0]), least, lapse, tolerance)) == want


def samples_of(spark, masks):
    return spark.createDataFrame([(i, int(k)) for i, m in enumerate(masks) for k in np.flatnonzero(m)], "rec long, idx long")


def test_debounce(spark, masks, lengths):
    def walk(mask, r):
        out, on, n = np.zeros(len(mask), bool), np.flatnonzero(mask), len(mask)
        for i, p in enumerate(on):
            to = on[i + 1] if i + 1 < len(on) else n
            if to - p - 1 < r:
                out[p:to] = True
        return out

    for r in (1, 4, 30):
        assert rows(maps.debounce(samples_of(spark, masks[0]), lengths, r)) == expect([walk(m, r) for m in masks[0]])


def test_sensation_map(spark, masks, lengths):
    def walk(press, imu, back, ahead):
        out = np.zeros(len(press), bool)
        for p in np.flatnonzero(press):
            window = slice(max(0, p - back), p + ahead + 1)
            out[window] = not imu[window].any()
        return out

    want = expect([walk(p, m, 6, 3) for p, m in zip(*masks, strict=True)])
    assert rows(maps.sensation_map(samples_of(spark, masks[0]), frame(spark, masks[1]), lengths, 6, 3)) == want


def test_contaminated_components_go(spark, masks):
    def walk(seg, imu):
        out, both = seg.copy(), seg | imu
        for a, b in runs(both):
            if (seg[a:b] & imu[a:b]).any():
                out[a:b] = False
        return out

    got = iv.merge(maps.without_contaminated(frame(spark, masks[0]), frame(spark, masks[1])))
    assert rows(got) == expect([walk(p, m) for p, m in zip(*masks, strict=True)])


def test_confusion_counts(spark, masks, lengths):
    rng = np.random.default_rng(5)
    imu = [rng.random(len(m)) < 0.01 for m in masks[0]]
    window, least = 5, 2

    def walk(det, press, imu):
        n, tp, fn, felt, gone = len(det), 0, 0, np.zeros(len(det), bool), np.zeros(len(det), bool)
        for a, b in runs(press):
            s = slice(max(0, a - 2), min(n, b + 3))
            if not imu[s].any():
                felt[s] = True
                tp, fn = tp + bool(det[s].any()), fn + (not det[s].any())
        for a, b in runs(det):
            if felt[a:b].any():
                gone[a:b] = True
        left = det[~(gone | felt)]
        fp = tn = start = 0
        while start < len(left):
            hit = left[start : start + window].sum() >= least
            fp, tn, start = fp + bool(hit), tn + (not hit), start + window + 1
        return tp, fp, tn, fn

    got = {r.rec: (r.tp, r.fp, r.tn, r.fn) for r in report.confusion_counts(frame(spark, masks[0]), frame(spark, masks[1]), frame(spark, imu), lengths, 2, 3, least, window).collect()}
    assert got == {i: walk(d, p, imu[i]) for i, (d, p) in enumerate(zip(*masks, strict=True))}
