"""Wider features and frames against sums that are written out."""

import math

import numpy as np
import pytest

from pulsegrid.functions import extended as ex
from pulsegrid.functions import spectral

X = np.random.default_rng(6).normal(size=61).cumsum()


def dft_power(x):
    n = len(x)
    return [abs(sum(x[i] * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i in range(n))) ** 2 for k in range(n // 2 + 1)]


def test_linear_prediction_solves_the_normal_equations():
    r = [sum(X[i] * X[i + k] for i in range(61 - k)) for k in range(5)]
    a = np.linalg.solve([[r[abs(i - j)] for j in range(4)] for i in range(4)], [-v for v in r[1:]])
    assert ex.linear_prediction(X) == pytest.approx(a)
    assert ex.linear_prediction(np.zeros(9)).tolist() == [0] * 4 and len(ex.linear_prediction(np.ones(2))) == 4


def test_autocorrelation_and_its_length():
    d = X - X.mean()
    plain = [sum(d[i] * d[i + k] for i in range(61 - k)) / sum(d * d) for k in range(61)]
    assert ex.autocorrelation(X) == pytest.approx(plain)
    assert ex.features(X, 64.0)["acf_length"] == next(k for k, v in enumerate(plain) if v < 1 / math.e)


def test_mel_cepstrum():
    mel, hertz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    power, top = dft_power(X), mel(32)
    edges = [hertz(top * i / 9) for i in range(10)]
    energies = []
    for f in range(8):
        total = 0.0
        for k, p in enumerate(power):
            hz = 32 * k / (len(power) - 1)
            total += p * max(0, min((hz - edges[f]) / (edges[f + 1] - edges[f]), (edges[f + 2] - hz) / (edges[f + 2] - edges[f + 1])))
        energies.append(math.log(total + 1e-12))
    want = [math.sqrt(2 / 8) * sum(e * math.cos(math.pi * k * (2 * m + 1) / 16) for m, e in enumerate(energies)) for k in range(1, 5)]
    got = ex.features(X, 64.0)
    assert [got[f"cepstrum_{k}"] for k in range(1, 5)] == pytest.approx(want)


def test_wavelets_keep_energy():
    x = X[:56]
    for level, energy in enumerate(ex.wavelet_energies(x)):
        size = 2 << level
        want = sum((x[i : i + size // 2].sum() - x[i + size // 2 : i + size].sum()) ** 2 / size for i in range(0, 56, size))
        assert energy == pytest.approx(want)


def test_fluctuation():
    profile, u, v = np.cumsum(X - X.mean()), [], []
    for n in (4, 8, 16):
        squares = []
        for at in range(0, 61 // n * n, n):
            t, y = np.arange(n), profile[at : at + n]
            line = np.polyval(np.polyfit(t, y, 1), t)
            squares += list((y - line) ** 2)
        u.append(math.log(n))
        v.append(math.log(math.sqrt(sum(squares) / len(squares))))
    assert ex.fluctuation(X) == pytest.approx(np.polyfit(u, v, 1)[0])


def test_the_rest_by_loops():
    f, s, fs, n = ex.features(X, 64.0), sorted(X), 64.0, 61
    level = lambda p: next(v for i, v in enumerate(s) if (i + 1) / n >= p)
    assert [f["ecdf_20"], f["ecdf_50"], f["ecdf_80"]] == [level(0.2), level(0.5), level(0.8)] and f["ecdf_slope"] == pytest.approx(0.25 / (level(0.75) - level(0.5)))
    steps = [b - a for a, b in zip(X, X[1:], strict=False)]
    assert f["zero_crossings"] == sum((a > 0) != (b > 0) for a, b in zip(X, X[1:], strict=False)) and f["turning_points"] == sum(a * b < 0 for a, b in zip(steps, steps[1:], strict=False))
    assert f["path_length"] == pytest.approx(sum(math.hypot(1, d) for d in steps)) and f["mean_abs_step"] == pytest.approx(sum(map(abs, steps)) / 60) and f["median_abs_step"] == pytest.approx(np.median(np.abs(steps)))
    assert f["slope"] == pytest.approx(np.polyfit(np.arange(n) / fs, X, 1)[0]) and f["time_centroid"] == pytest.approx(sum(i / fs * v * v for i, v in enumerate(X)) / sum(v * v for v in X))
    p = dft_power(X)
    share, at = [v / sum(p) for v in p], [k * fs / n for k in range(len(p))]
    centre = sum(a * b for a, b in zip(share, at, strict=True))
    assert f["freq_centroid"] == pytest.approx(centre) and f["freq_spread"] == pytest.approx(math.sqrt(sum(a * (b - centre) ** 2 for a, b in zip(share, at, strict=True))))
    assert f["freq_rolloff"] == pytest.approx(next(b for k, b in enumerate(at) if sum(share[: k + 1]) >= 0.95)) and f["freq_entropy"] == pytest.approx(-sum(a * math.log2(a) for a in share if a > 0))


@pytest.mark.parametrize("x", [[0.0], [3.0], [1.0, 1.0], [0.0] * 40, [1.0, -1.0] * 20, list(range(7))])
def test_any_segment_has_all_features(x):
    got = ex.features(np.array(x), 64.0)
    assert tuple(got) == ex.NAMES and len(got) == 28 and all(map(math.isfinite, got.values()))


def test_columns(spark):
    df = spark.createDataFrame([(1, X.tolist()), (2, None), (3, [])], "id int, x array<double>")
    rows = {r.id: r.e for r in df.select("id", ex.extended(df.x, 64.0).alias("e")).collect()}
    assert rows[2] is None and rows[3] is None and rows[1].asDict() == pytest.approx(ex.features(X, 64.0))
    frames = spectral.stft(df, ["id"], "x", 16, 8, 64.0).collect()
    assert len(frames) == 6 * 9 and {r.id for r in frames} == {1} and max(r.time for r in frames) == (8 + 40) / 64


def test_matched_filter_is_zero_by_default_for_long_segments(spark):
    assert spectral.matched(np.ones(300) * np.arange(300), 256, 128, 1.0, 50.0, 10.0) == 0.0
    t, n = (8 + 8 * np.arange(6)) / 64, 16
    power = spectral.frame_powers(X[:61], 16, 8, 64.0)
    atom = 2**0.25 * np.exp(-np.pi * (t[:, None] - 0.3) ** 2) * np.exp(-2j * np.pi * np.arange(9)[None, :] * 64 / n * 0.1)
    assert spectral.matched(X, 16, 8, 64.0, 0.3, 0.1) == pytest.approx(abs((power.T @ atom.conj()).sum()))
