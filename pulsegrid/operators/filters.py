"""Signal filters: zero-phase Butterworth band-pass, rotation to one axis, moving sums, peaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def butterworth_sections(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a digital Butterworth band-pass, by the bilinear transform."""
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    w1, w2 = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    half, centre = prototype * (w2 - w1) / 2, w1 * w2
    root = np.sqrt(half**2 - centre + 0j)
    analog = np.concatenate([half + root, half - root])
    poles = (2 * fs + analog) / (2 * fs - analog)
    gain = np.real((w2 - w1) ** order * (2 * fs) ** order / np.prod(2 * fs - analog))
    pairs = sorted(poles[poles.imag > 1e-12], key=lambda p: abs(abs(p) - 1), reverse=True)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    denominators = [(1.0, -2 * p.real, abs(p) ** 2) for p in pairs] + [(1.0, -(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sections = np.array([(1.0, 0.0, -1.0, *d) for d in denominators])
    sections[0, :3] *= gain
    return sections


def _steady(section: np.ndarray) -> np.ndarray:
    """State of a section (transposed direct form) that a constant input of 1 keeps."""
    b, a = section[:3], section[3:]
    y = b.sum() / a.sum()
    return np.array([y - b[0], b[2] - a[2] * y])


def _section(x: np.ndarray, section: np.ndarray, state: np.ndarray, block: int = 2048) -> np.ndarray:
    """One section over x, exactly: blocks in parallel from a zero state, then each block's own state added."""
    b0, b1, b2, _, a1, a2 = section
    n = len(x)
    block = max(1, min(block, n))
    rows = -(-n // block)
    u = np.zeros((rows, block))
    u.ravel()[:n] = x
    y, s1, s2 = np.empty_like(u), np.zeros(rows), np.zeros(rows)
    free, f1, f2 = np.empty((block, 2)), np.array([1.0, 0.0]), np.array([0.0, 1.0])
    for i in range(block):
        v = u[:, i]
        out = b0 * v + s1
        s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
        y[:, i] = out
        free[i] = f1
        f1, f2 = -a1 * f1 + f2, -a2 * f1
    step = np.array([f1, f2])
    for r in range(rows):
        y[r] += free @ state
        state = step @ state + np.array([s1[r], s2[r]])
    return y.ravel()[:n]


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward filtering, with odd extension at the ends and steady initial states."""
    x = np.asarray(x, float)
    edge = min(3 * (2 * len(sections) + 1), len(x) - 1)
    if edge < 1:
        return np.zeros_like(x)
    y = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    for _ in range(2):
        scale, out = 1.0, y
        for s in sections:
            out = _section(out, s, _steady(s) * scale * y[0])
            scale *= s[:3].sum() / s[3:].sum()
        y = out[::-1]
    return y[edge:-edge]


def zero_phase_each(recordings: Sequence[np.ndarray], sections: np.ndarray, most: int = 2048) -> list[np.ndarray]:
    """zero_phase of every recording, to the bit; those of one block with their extensions and of like length are filtered in step."""
    out = [np.empty(0)] * len(recordings)
    classes: dict[int, list[int]] = {}
    ahead = 3 * (2 * len(sections) + 1)
    for k, x in enumerate(recordings):
        if 1 < len(x) <= most - 2 * ahead:
            classes.setdefault(len(x).bit_length(), []).append(k)
        else:
            out[k] = zero_phase(x, sections)
    for ks in classes.values():
        n = np.array([len(recordings[k]) for k in ks])
        edge = np.minimum(ahead, n - 1)
        size = n + 2 * edge
        y = np.zeros((size.max(), len(ks)))  # a column for each, zeros after its end
        for j, (k, e) in enumerate(zip(ks, edge, strict=True)):
            x = np.asarray(recordings[k], float)
            y[: size[j], j] = np.concatenate([2 * x[0] - x[e:0:-1], x, 2 * x[-1] - x[-2 : -e - 2 : -1]])
        back = (size - 1 - np.arange(len(y))[:, None]).clip(0)
        for _ in range(2):
            scale, first = 1.0, y[0].copy()
            for section in sections:
                b0, b1, b2, _, a1, a2 = section
                s1 = s2 = np.zeros(len(ks))
                free, f1, f2 = np.empty((len(y), 2)), np.array([1.0, 0.0]), np.array([0.0, 1.0])
                for i in range(len(y)):
                    v = y[i]
                    now = b0 * v + s1
                    s1, s2 = b1 * v - a1 * now + s2, b2 * v - a2 * now
                    y[i] = now
                    free[i] = f1
                    f1, f2 = -a1 * f1 + f2, -a2 * f1
                steady = _steady(section) * scale
                for j, x0 in enumerate(first):
                    y[: size[j], j] += free[: size[j]] @ (steady * x0)
                scale *= section[:3].sum() / section[3:].sum()
            y = np.take_along_axis(y, back, 0)
        for j, (k, e) in enumerate(zip(ks, edge, strict=True)):
            out[k] = y[e : e + n[j], j].copy()
    return out


def whole_recordings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole recordings and where each starts, of rows whose `_at` is 1 in the first of a recording: of `most` rows or a little more, or of one recording."""
    held, rows, need = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < need:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(table["_at"].to_numpy() == 1)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
            table = table.slice(starts[-1])
        held, rows = table.to_batches(), table.num_rows
        need = max(most, 2 * rows)  # a long recording is not searched again for every batch
    if rows:
        table = pa.Table.from_batches(held)
        yield table, np.flatnonzero(table["_at"].to_numpy() == 1)


def band_pass(samples: DataFrame, bands: dict[str, tuple[float, float]], fs: float, order: int = 5, most: int = 100_000) -> DataFrame:
    """Filter the named columns of (rec, idx, ...) in place; the filter is a recurrence, so a recording stays in one task.

    The rows come sorted by recording, and a task filters many short recordings at a time: about `most` samples.
    """
    designs = {c: butterworth_sections(order, *band, fs) for c, band in bands.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_recordings(batches, most):
            for column, sections in designs.items():
                x = pc.cast(table[column], pa.float64()).to_numpy()
                y = np.concatenate(zero_phase_each(np.split(x, starts[1:]), sections))
                table = table.set_column(table.column_names.index(column), column, pa.array(y, from_pandas=True))
            yield from table.drop_columns(["_at"]).to_batches(max_chunksize=most)

    numbered = samples.withColumn("_at", F.row_number().over(Window.partitionBy("rec").orderBy(F.asc_nulls_last("idx"))))
    kinds = StructType([StructField(f.name, DoubleType() if f.name in bands else f.dataType) for f in samples.schema])
    return numbered.mapInArrow(run, kinds)


def first_component(samples: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Scores of the first principal component by recording; the score of largest magnitude is positive.

    The covariances are one grouped aggregate; only the 3 by 3 eigenproblem runs in Python.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = samples.groupBy("rec").agg(*(F.avg(c).alias(f"m_{c}") for c in columns), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("cov"))
    n = len(columns)

    @F.pandas_udf("array<double>")
    def axis(rows: pd.Series) -> pd.Series:
        def one(v):
            m = np.zeros((n, n))
            m[np.triu_indices(n)] = v
            return np.linalg.eigh(m + np.triu(m, 1).T)[1][:, -1].tolist()

        return rows.map(one)

    sums = sums.withColumn("axis", axis("cov"))
    scored = samples.join(sums, "rec")
    score = sum(((F.col(c) - F.col(f"m_{c}")) * F.get("axis", F.lit(i)) for i, c in enumerate(columns)), F.lit(0.0))
    scored = scored.withColumn("_score", score)
    sign = scored.groupBy("rec").agg(F.signum(F.max_by("_score", F.struct(F.abs("_score"), -F.col("idx")))).alias("_sign"))
    return scored.join(sign, "rec").select(*samples.columns, (F.col("_score") * F.when(F.col("_sign") < 0, -1.0).otherwise(1.0)).alias(name))


def zero_outliers(x: Column, median: Column, mad: Column, m: float) -> Column:
    """0 in place of values m or more deviations from the median; unchanged if the deviation is 0."""
    return F.when((mad > 0) & (F.abs(x - median) / F.when(mad > 0, mad) >= m), 0.0).otherwise(x)


def moving_average(x: str, width: int) -> Column:
    """Centred mean over `width` samples, zeros beyond the ends, always divided by width.

    As a difference of running sums: a wide sliding frame would be summed anew at every row.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    if width <= 64:
        return F.sum(x).over(order.rowsBetween(-(width // 2), (width - 1) // 2)) / width
    running = F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, (width - 1) // 2))
    before = F.coalesce(F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, -(width // 2) - 1)), F.lit(0.0))
    return (running - before) / width


def local_maxima(samples: DataFrame, x: str, by: Sequence[str] = ("rec",)) -> DataFrame:
    """(by, idx, x): samples above both neighbours; a plateau counts once, at its middle. The ends are no maxima."""
    order = Window.partitionBy(*by).orderBy("idx")
    runs = samples.select(*by, "idx", F.col(x).alias("v"), (F.lag(x).over(order) != F.col(x)).alias("_new"))
    runs = runs.withColumn("_run", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy(*by, "_run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.first("v").alias("v"))
    near = Window.partitionBy(*by).orderBy("a")
    flat = flat.withColumn("_l", F.lag("v").over(near)).withColumn("_r", F.lead("v").over(near))
    return flat.where((F.col("v") > F.col("_l")) & (F.col("v") > F.col("_r"))).select(*by, F.floor((F.col("a") + F.col("b")) / 2).alias("idx"), F.col("v").alias("x"))


def keep_distant(idx: Sequence[int], height: Sequence[float], distance: int) -> list[int]:
    """Places of the peaks left when, from the highest down, each removes others closer than `distance`."""
    order, alive = np.argsort(np.asarray(height), kind="stable")[::-1], np.ones(len(idx), bool)
    at = np.asarray(idx)
    for i in order:
        if alive[i]:
            alive[(np.abs(at - at[i]) < distance) & (np.arange(len(at)) != i)] = False
    return np.flatnonzero(alive).tolist()


def distant(peaks: DataFrame, distance: int, by: Sequence[str] = ("rec",), most: int = 100_000) -> DataFrame:
    """Peaks (by, idx, x) that keep_distant leaves of each key's; a task thins the peaks of many keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_recordings(batches, most):
            idx, x = table["idx"].to_numpy(), table["x"].to_numpy()
            kept = [a + np.array(keep_distant(idx[a:b], x[a:b], distance), int) for a, b in zip(starts, [*starts[1:], len(idx)], strict=True)]
            yield from table.take(pa.array(np.concatenate(kept))).drop_columns(["_at"]).to_batches()

    return peaks.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("idx"))).mapInArrow(run, peaks.schema)
