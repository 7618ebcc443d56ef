"""A wider set of segment features, from their published definitions: distribution, shape in time, spectrum, prediction, scaling.

Every feature is a named function of a segment and its sampling rate, finite for any segment of one value or more;
`extended` gives them all from one Arrow pass over an array<double> column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREDICTION = 4  # coefficients of linear prediction
MEL = 8  # triangular filters of the mel bank
CEPSTRUM = 4  # coefficients kept of its cepstrum
WAVELET = 3  # levels of the Haar decomposition
LEAST_POWER = 1e-12


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Of the centred segment at lags 0, 1, ..., by the spectrum of twice its length; 1 at lag 0 if it varies."""
    d = x - x.mean()
    full = np.fft.irfft(np.abs(np.fft.rfft(d, 2 * len(d))) ** 2, 2 * len(d))[: len(d)]
    return full / full[0] if full[0] > LEAST_POWER else np.zeros(len(d))


def linear_prediction(x: np.ndarray, order: int = PREDICTION) -> np.ndarray:
    """a[1..order] with x[t] near -sum a[k] x[t - k], by the Levinson-Durbin recursion; zeros where nothing is left to predict."""
    r = np.array([x[: len(x) - k] @ x[k:] if k < len(x) else 0.0 for k in range(order + 1)])
    a, error = np.r_[1.0, np.zeros(order)], r[0]
    for i in range(1, order + 1):
        if error <= LEAST_POWER:
            break
        k = -(a[:i] @ r[i:0:-1]) / error
        a[: i + 1] = a[: i + 1] + k * a[: i + 1][::-1]
        error *= 1 - k * k
    return a[1:]


def mel_bank(bins: int, fs: float, filters: int = MEL) -> np.ndarray:
    """Triangles of equal width on the mel scale between 0 and fs / 2, over the bins of a spectrum."""
    to_mel, to_hertz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    at, edges = np.linspace(0, fs / 2, bins), to_hertz(np.linspace(0, to_mel(fs / 2), filters + 2))
    rise = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def cepstrum(power: np.ndarray, fs: float) -> np.ndarray:
    """Cosine transform of the mel bank's log energies, coefficients 1 to CEPSTRUM."""
    energy = np.log(mel_bank(len(power), fs) @ power + LEAST_POWER)
    k, m = np.arange(1, CEPSTRUM + 1)[:, None], np.arange(MEL)[None, :]
    return np.sqrt(2 / MEL) * (np.cos(np.pi * k * (2 * m + 1) / (2 * MEL)) @ energy)


def wavelet_energies(x: np.ndarray) -> list[float]:
    """Energy of the Haar details of each level, the finest first; an odd last value is met by itself."""
    out = []
    for _ in range(WAVELET):
        x = np.append(x, x[-1]) if len(x) % 2 else x
        out.append(float((((x[::2] - x[1::2]) / np.sqrt(2)) ** 2).sum()))
        x = (x[::2] + x[1::2]) / np.sqrt(2)
    return out


def fluctuation(x: np.ndarray, least: int = 4) -> float:
    """Exponent of detrended fluctuation: how the spread around straight lines grows with the window; 0 without two windows."""
    profile, sizes = np.cumsum(x - x.mean()), []
    while (n := least << len(sizes)) <= len(x) // 2:
        sizes.append(n)
    spreads = []
    for n in sizes:
        t = np.arange(n) - (n - 1) / 2
        parts = profile[: len(profile) // n * n].reshape(-1, n)
        rest = parts - parts.mean(1, keepdims=True) - (parts @ t / (t @ t))[:, None] * t
        spreads.append(np.sqrt((rest**2).mean()))
    if len(sizes) < 2 or min(spreads) <= LEAST_POWER:
        return 0.0
    u, v = np.log(sizes), np.log(spreads)
    return float(((u - u.mean()) * (v - v.mean())).sum() / ((u - u.mean()) ** 2).sum())


def features(x: np.ndarray, fs: float) -> dict[str, float]:
    n, ordered, steps = len(x), np.sort(x), np.diff(x)
    level = lambda p: float(ordered[min(n - 1, max(0, int(np.ceil(p * n)) - 1))])
    t = np.arange(n) / fs
    spread_t = ((t - t.mean()) ** 2).sum()
    low = np.flatnonzero(autocorrelation(x) < 1 / np.e)
    power = np.abs(np.fft.rfft(x)) ** 2
    at, whole = np.fft.rfftfreq(n, 1 / fs), power.sum()
    share = power / whole if whole > LEAST_POWER else np.zeros(len(power))
    centre = float(share @ at)
    named = {
        "ecdf_20": level(0.2), "ecdf_50": level(0.5), "ecdf_80": level(0.8), "ecdf_slope": 0.25 / d if (d := level(0.75) - level(0.5)) > LEAST_POWER else 0.0,
        "acf_length": float(low[0]) if len(low) else float(n), "zero_crossings": float((np.sign(x[1:]) != np.sign(x[:-1])).sum()), "turning_points": float((steps[1:] * steps[:-1] < 0).sum()),
        "path_length": float(np.sqrt(1 + steps**2).sum()), "mean_abs_step": float(np.abs(steps).mean()) if n > 1 else 0.0, "median_abs_step": float(np.median(np.abs(steps))) if n > 1 else 0.0,
        "slope": float(((t - t.mean()) * x).sum() / spread_t) if spread_t else 0.0, "time_centroid": float((t * x**2).sum() / (x**2).sum()) if (x**2).sum() > LEAST_POWER else 0.0, "fluctuation": fluctuation(x),
        "freq_centroid": centre, "freq_spread": float(np.sqrt(share @ (at - centre) ** 2)), "freq_rolloff": float(at[np.searchsorted(np.cumsum(share), 0.95 - 1e-12)]) if whole > LEAST_POWER else 0.0,
        "freq_entropy": float(-(share[share > 0] * np.log2(share[share > 0])).sum()),
    }
    named |= {f"prediction_{k + 1}": float(v) for k, v in enumerate(linear_prediction(x))}
    named |= {f"cepstrum_{k + 1}": float(v) for k, v in enumerate(cepstrum(power, fs))}
    return named | {f"wavelet_{k + 1}": v for k, v in enumerate(wavelet_energies(x))}


NAMES = tuple(features(np.arange(8.0), 8.0))


def extended(x: Column, fs: float) -> Column:
    """struct of all features; null for a null or empty segment."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None or not len(v) else list(features(np.asarray(v, float), fs).values()))

    values = run(x)
    return F.when(values.isNotNull(), F.transform(F.array(values), lambda v: F.struct(*(F.get(v, F.lit(i)).alias(n) for i, n in enumerate(NAMES))))[0])
