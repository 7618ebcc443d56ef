"""Fourier and Hilbert kernels, as Arrow-backed pandas UDFs over array<double> columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ((1, 2), (2, 5), (5, 10), (10, 20), (20, 30))


def band_energies(x: np.ndarray, fs: float) -> list[float]:
    """Energy of the bins in each band, both ends included; the bin axis runs evenly from 0 to fs/2."""
    power = np.abs(np.fft.rfft(x)) ** 2
    at = np.linspace(0, fs / 2, len(x) // 2 + 1)
    return [float(power[(at >= a) & (at <= b)].sum()) for a, b in BANDS]


def frequency_mode(x: np.ndarray, fs: float, above: float) -> float:
    """Frequency of the greatest amplitude, of bins past the one at `above`."""
    n = len(x)
    amplitude = np.abs(np.fft.rfft(x)) / n
    amplitude[1:-1] *= 2
    skip = int(np.ceil(above * n / fs + 1))
    return float((skip + np.argmax(amplitude[skip:])) * fs / n) if skip < len(amplitude) else float("nan")


def hilbert_stats(x: np.ndarray, fs: float) -> list[float]:
    """Mean, deviation and range of instantaneous amplitude and frequency."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    analytic = np.fft.ifft(np.fft.fft(x) * gain)
    amplitude = np.abs(analytic)
    freq = np.diff(np.unwrap(np.angle(analytic))) * fs / (2 * np.pi)
    if not len(freq):
        freq = np.zeros(1)
    return [float(v) for v in (amplitude.mean(), freq.mean(), amplitude.std(), freq.std(), np.ptp(amplitude), np.ptp(freq))]


def frame_powers(x: np.ndarray, window: int, hop: int, fs: float) -> np.ndarray:
    """Power density (frame, bin) of frames of `window` samples every `hop`, each centred and under a periodic Hann window.

    A segment shorter than the window is one frame of its own length; power is one-sided.
    """
    window = min(window, len(x))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * taper)) ** 2 / (fs * max((taper**2).sum(), 1e-300))
    power[:, 1 : (window + 1) // 2] *= 2
    return power


def matched(x: np.ndarray, window: int, hop: int, fs: float, time: float, frequency: float) -> float:
    """Magnitude of the frames' powers against a Gaussian atom at `time` seconds that turns by `frequency` along the bins' axis.

    Atom and powers meet frame by frame, every bin with every other, so that it is a product of two sums for each frame.
    """
    power = frame_powers(x, window, hop, fs)
    n = min(window, len(x))
    at = (n / 2 + hop * np.arange(len(power))) / fs
    atom = 2**0.25 * np.exp(-np.pi * (at - time) ** 2) * np.exp(2j * np.pi * np.fft.rfftfreq(n, 1 / fs) * frequency).sum()
    return float(np.abs(power.sum(1) @ atom))


def _over(kernel, kind: str, x: Column) -> Column:
    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None or not len(v) else kernel(np.asarray(v, float)))

    return run(x)


def bands(x: Column, fs: float) -> Column:
    return _over(lambda v: band_energies(v, fs), "array<double>", x)


def mode(x: Column, fs: float, above: float = 1.0) -> Column:
    return _over(lambda v: frequency_mode(v, fs, above), "double", x)


def hilbert(x: Column, fs: float) -> Column:
    return _over(lambda v: hilbert_stats(v, fs), "array<double>", x)


def stft(segments: DataFrame, keys: Sequence[str], x: str, window: int = 256, hop: int = 128, fs: float = 1.0) -> DataFrame:
    """keys, frame, bin, time (of the frame's middle), frequency and power of each segment; a null or empty one has no rows."""

    @F.pandas_udf("array<array<double>>")
    def powers(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None or not len(v) else frame_powers(np.asarray(v, float), window, hop, fs).tolist())

    n = F.least(F.lit(window), F.col("_n"))
    frames = segments.select(*keys, F.size(x).alias("_n"), F.posexplode(powers(F.col(x))).alias("frame", "_bins"))
    bins = frames.select(*keys, "_n", "frame", F.posexplode("_bins").alias("bin", "power"))
    return bins.select(*keys, "frame", "bin", ((n / 2 + hop * F.col("frame")) / fs).alias("time"), (F.col("bin") * fs / n).alias("frequency"), "power")


def matched_filter(x: Column, window: int = 256, hop: int = 128, fs: float = 1.0, time: float = 50.0, frequency: float = 10.0) -> Column:
    """With these parameters 0 for segments of a window or more: their first frame is 78 deviations of the atom away from it."""
    return _over(lambda v: matched(v, window, hop, fs, time, frequency), "double", x)
