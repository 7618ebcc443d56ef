"""Filters, array kernels and spectral kernels against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays, scalar, spectral
from pulsegrid.operators import align, filters


def test_butterworth_gain():
    fs = 1024.0
    sections = filters.butterworth_sections(5, 1.0, 30.0, fs)

    def gain(f):
        z = np.exp(-2j * np.pi * f / fs)
        return abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z) for s in sections]))

    assert len(sections) == 5
    assert gain(1.0) == pytest.approx(2**-0.5, rel=1e-6) and gain(30.0) == pytest.approx(2**-0.5, rel=1e-6)
    assert gain(6.0) == pytest.approx(1, rel=1e-3) and gain(0.05) < 1e-5 and gain(300.0) < 1e-4
    assert all(abs(np.roots(s[3:])).max() < 1 for s in sections)


def test_blocked_section_is_the_recurrence():
    rng = np.random.default_rng(0)
    x, section, state = rng.normal(size=777), filters.butterworth_sections(5, 1, 30, 256)[2], np.array([0.3, -0.1])
    b0, b1, b2, _, a1, a2 = section
    s1, s2 = state
    want = []
    for v in x:
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        want.append(y)
    for block in (1, 7, 64, 2048):
        assert np.allclose(filters._section(x, section, state, block), want, atol=1e-9)


def test_zero_phase_keeps_the_band():
    fs = 256.0
    t = np.arange(4096) / fs
    tone = np.sin(2 * np.pi * 8 * t)
    out = filters.zero_phase(tone + 3 + 0.5 * np.sin(2 * np.pi * 100 * t), filters.butterworth_sections(5, 1, 30, fs))
    assert np.abs(out - tone)[500:-500].max() < 0.02
    assert filters.zero_phase(np.array([1.0]), filters.butterworth_sections(5, 1, 30, fs)).tolist() == [0.0]


def test_band_pass_by_recording(spark):
    rows = [(r, i, float(np.sin(i / 5 + r))) for r in (1, 2) for i in range(300)]
    got = filters.band_pass(spark.createDataFrame(rows, "rec long, idx long, x double"), {"x": (1.0, 30.0)}, 256.0).toPandas()
    for r in (1, 2):
        x = np.array([v for q, _, v in rows if q == r])
        want = filters.zero_phase(x, filters.butterworth_sections(5, 1.0, 30.0, 256.0))
        assert np.allclose(got[got.rec == r].sort_values("idx").x, want)


def test_band_pass_of_many_short_recordings_and_long_ones(spark):
    sections = filters.butterworth_sections(5, 1.0, 30.0, 256.0)
    rng = np.random.default_rng(3)
    lengths = [1, 2, 3, 30, 33, 34, 1900, 2049, 5000, *rng.integers(40, 100, 300)]
    signals = [rng.normal(size=n).cumsum() for n in lengths]
    for got, x in zip(filters.zero_phase_each(signals, sections), signals, strict=True):
        assert (got == filters.zero_phase(x, sections)).all()
    alone = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(filters, "zero_phase", lambda x, _: alone.append(len(x)) or x)
        filters.zero_phase_each(signals, sections)
    assert alone == [1, 2049, 5000]  # not one call a recording
    rows = [(None if r == 4 else r, i, float(v), None if r == 7 and i == 1 else float(v), str(i)) for r, x in enumerate(signals[:40]) for i, v in enumerate(x)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "rec long, idx long, x double, y double, note string")
    for most in (1, 700, 100_000):
        got = filters.band_pass(df, {"x": (1.0, 30.0), "y": (1.0, 30.0)}, 256.0, most=most).toPandas()
        assert len(got) == len(rows) and (got.note == got.idx.astype(str)).all()
        for r, x in enumerate(signals[:40]):
            mine = got[got.rec.isna() if r == 4 else got.rec == r].sort_values("idx")
            want = filters.zero_phase(x, sections)
            assert np.allclose(mine.x, want, atol=1e-9)
            assert mine.y.isna().all() if r == 7 else np.allclose(mine.y, want, atol=1e-9)


def test_first_component(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)], "rec long, idx long, a double, b double, c double")
    got = filters.first_component(df, ["a", "b", "c"], "s").orderBy("idx").toPandas().s.to_numpy()
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][0]
    want *= np.sign(want[np.argmax(np.abs(want))])
    assert np.allclose(got, want)


def test_peaks(spark):
    v = [0, 1, 1, 1, 0, 2, 2, 3, 3, 2, 5, 1, 1]
    got = filters.local_maxima(spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "rec long, idx long, x double"), "x").orderBy("idx").collect()
    assert [(r.idx, r.x) for r in got] == [(2, 1.0), (7, 3.0), (10, 5.0)]
    assert filters.keep_distant([0, 3, 5, 20], [1.0, 5.0, 4.0, 1.0], 4) == [1, 3]


def test_array_kernels(spark):
    rng = np.random.default_rng(2)
    segments = [rng.normal(size=n).tolist() for n in (3, 8, 33, 64)] + [[1.0, 1.0, 2.0, 2.0, 2.0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(segments)], "id long, x array<double>")
    stats = arrays.convolution_stats(F.col("x"))
    got = df.select("id", arrays.convolved(F.col("x")).alias("conv"), arrays.haar_approximation(F.col("x")).alias("haar"), arrays.simpson(F.col("x"), 0.5).alias("area"), *(v.alias(k) for k, v in stats.items())).orderBy("id").collect()
    assert len(stats) == 21
    for s, r in zip(segments, got, strict=True):
        x = np.array(s)
        assert np.allclose(r.conv, np.convolve(x, arrays.GAUSSIAN7, "full")[3:-3])
        pairs = np.append(x, x[-1:]) if len(x) % 2 else x
        assert np.allclose(r.haar, (pairs[::2] + pairs[1::2]) / np.sqrt(2))
        d = x - x.mean()
        assert r["skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and r["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
        assert r["slope"] == pytest.approx(np.gradient(x).mean()) and r["iq_rng"] == pytest.approx(np.subtract(*np.quantile(x, (0.75, 0.25))))
        assert r["zero_cross_rate"] == pytest.approx((np.diff(np.sign(x)) != 0).sum() / len(x))
        p = np.unique(x, return_counts=True)[1] / len(x)
        assert r["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert got[2]["area"] == pytest.approx(sum(w * v for w, v in zip([1] + [4, 2] * 15 + [4, 1], segments[2], strict=True)) / 3 * 0.5)
    straight = spark.createDataFrame([([float(i * i) for i in range(n)],) for n in (5, 6, 7, 10)], "x array<double>")
    for r in straight.select(F.size("x").alias("n"), arrays.simpson(F.col("x"), 1.0).alias("a")).collect():
        assert r.a == pytest.approx((r.n - 1) ** 3 / 3)  # exact for a parabola, even counts included


def test_spectral_kernels():
    fs, n = 64.0, 128
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * 8 * t)
    assert spectral.frequency_mode(x, fs, 1.0) == 8.0
    energy = spectral.band_energies(x, fs)
    assert energy[2] == pytest.approx((n / 2) ** 2) and energy[0] == pytest.approx(0, abs=1e-9)
    amp, freq, *_ = spectral.hilbert_stats(x, fs)
    assert amp == pytest.approx(1) and freq == pytest.approx(8, rel=1e-6)
    assert spectral.hilbert_stats(np.ones(1), fs)[1] == 0 and np.isnan(spectral.frequency_mode(np.ones(2), fs, 5.0))


def test_alignment(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(1, 0, None)], "rec long, idx long, v double")
    got = align.interpolate(df, "v", "y").orderBy("rec", "idx").collect()
    assert [r.y for r in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0, None]
    long = spark.range(20).select(F.lit(0).alias("rec"), F.col("id").alias("idx"))
    assert [r.idx for r in align.trim_edges(long, 1.0).orderBy("idx").collect()] == list(range(10))
    assert align.trim_edges(long, 4.0).count() == 0 and align.trim_edges(long, 4.0, keep_short=True).count() == 20


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(scalar.iso_millis(F.lit(1700000000500)).alias("t"), scalar.str2bool(F.lit("Yes")).alias("b"), *(c.alias(n) for c, n in zip(scalar.split_uri(F.lit("s3://my_bucket/a/b.dat")), "uk", strict=True))).first()
    assert (row.t, row.b, row.u, row.k) == ("2023-11-14T22:13:20.500Z", True, "my_bucket", "a/b.dat")
    with pytest.raises(Exception, match="no boolean"):
        one.select(scalar.str2bool(F.lit("maybe"))).collect()
    angles = one.select(*scalar.euler_degrees(*(F.lit(float(v)) for v in (np.cos(np.pi / 8), np.sin(np.pi / 8), 0, 0)))).first()
    assert angles[0] == pytest.approx(45) and angles[1] == pytest.approx(0) and angles[2] == pytest.approx(0)


def test_interpolation_is_linear_in_the_samples(spark):
    """Twice the samples of one recording take about twice the time, not four times."""
    import time

    def took(n):
        s = spark.range(n).select(F.lit(0).alias("rec"), F.col("id").alias("idx"), F.when(F.col("id") % 8 == 3, F.sin("id")).alias("v"), F.when(F.col("id") % 50 == 49, F.col("id")).alias("w"))
        began = time.time()
        row = align.interpolated(s, {"v": "v", "w": "w"}).withColumn("f", align.filled(F.col("w"))).agg(F.sum("v"), F.min("f"), F.count("w")).first()
        assert row[1] == 49 and row[2] == n
        return time.time() - began

    took(1000)
    assert took(400_000) < 3 * took(200_000) + 2


def test_interpolation_of_several_channels(spark):
    rows = [(r, i, *(float(i * k) if (i + k) % 3 == 0 else None for k in (1, 2))) for r in (0, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "rec long, idx long, a double, b double")
    got = align.interpolated(df, {"a": "a", "b": "c"}).orderBy("rec", "idx").toPandas()
    for r in (0, 1):
        for k, name in ((1, "a"), (2, "c")):
            known = [i for i in range(10) if (i + k) % 3 == 0]
            assert np.allclose(got[got.rec == r][name], np.interp(range(10), known, [i * k for i in known]))
