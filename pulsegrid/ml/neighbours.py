"""Neighbourhood components: a linear map under which a row's nearest neighbours are of its own class.

The objective is the expected number of rows that a stochastic neighbour (softmax of negative squared distances) names
rightly. Its gradient is a sum over all pairs of rows: blocks of rows are tasks, each meets all other rows block by block
in matrix products, and their parts are one grouped sum. The map is improved by limited-memory quasi-Newton steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512  # rows that a task holds distances of at a time


def block_part(a: np.ndarray, x: np.ndarray, y: np.ndarray, at: int, to: int) -> tuple[float, np.ndarray]:
    """The objective of rows at..to and its gradient in a. Distances are held for one block, not for all rows."""
    e = x @ a.T
    own = e[at:to]
    apart = (own**2).sum(1)[:, None] + (e**2).sum(1)[None, :] - 2 * own @ e.T
    apart[np.arange(to - at), np.arange(at, to)] = np.inf
    p = np.exp(apart.min(1, keepdims=True) - apart)
    p /= p.sum(1, keepdims=True)
    same = y[at:to, None] == y[None, :]
    right = (p * same).sum(1, keepdims=True)
    w = p * (same - right)
    gradient = own.T @ (w @ x) + e.T @ (w.T @ x[at:to]) - e.T @ (w.sum(0)[:, None] * x)
    return float(right.sum()), 2 * gradient


def climbed(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tolerance: float = 1e-5, memory: int = 10) -> np.ndarray:
    """A maximum by limited-memory BFGS steps, each halved until the value rises enough."""
    at, (best, up) = start, value(start)
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(rounds):
        if np.abs(up).max() <= tolerance:
            break
        way, scales = up.copy(), []
        for s, g in reversed(steps):
            scales.append((s * way).sum() / (s * g).sum())
            way -= scales[-1] * g
        way *= (steps[-1][0] * steps[-1][1]).sum() / (steps[-1][1] ** 2).sum() if steps else 1 / max(np.abs(up).max(), 1)
        for (s, g), scale in zip(steps, reversed(scales), strict=True):
            way += (scale - (g * way).sum() / (s * g).sum()) * s
        step, slope = 1.0, (way * up).sum()
        while step > 1e-10:
            new, slope_there = value(at + step * way)
            if new >= best + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        moved, turned = step * way, up - slope_there
        if (moved * turned).sum() > 1e-12:
            steps.append((moved, turned))
        done = new - best <= tolerance * max(abs(best), 1)
        at, best, up = at + moved, new, slope_there
        if done:
            break
    return at


def principal_axes(x: np.ndarray, k: int) -> np.ndarray:
    """The first k principal axes, the greatest entry of each positive."""
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :k].T
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def neighbour_components(df: DataFrame, columns: Sequence[str], label: str, components: int = 30, rounds: int = 50, most_rows: int = 20_000, seed: int = 0) -> np.ndarray:
    """The map, a row per component. It starts from the principal axes.

    Rows with a null in a column or the label are left out. The work is the square of the number of rows, so
    at most most_rows of them are fitted, those of least hash; they are broadcast, with the bound
    most_rows times the number of columns. Fewer than two rows, or none, give the first unit vectors.
    """
    spark, k = df.sparkSession, min(components, len(columns))
    rows = df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(label).cast("int").alias("y")).dropna(subset=["y"]).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    taken = rows.orderBy(F.xxhash64(F.lit(seed), "x", "y"), "x", "y").limit(most_rows).collect()
    if len(taken) < 2:
        return np.eye(len(columns))[:k]
    x, y = np.array([r.x for r in taken]), np.array([r.y for r in taken])
    x = x - x.mean(0)
    shared = spark.sparkContext.broadcast((x, y))
    blocks = spark.range(-(-len(x) // BLOCK), numPartitions=min(-(-len(x) // BLOCK), 4 * spark.sparkContext.defaultParallelism))

    def value(a: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = shared.value
            for batch in batches:
                parts = [block_part(a, x, y, b * BLOCK, min((b + 1) * BLOCK, len(x))) for b in batch.column("id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([np.r_[v, g.ravel()] for v, g in parts], pa.list_(pa.float64()))], names=["part"])

        sums = blocks.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(a.size + 1)
        for r in sums:
            out[r["at"]] = r.v
        return out[0], out[1:].reshape(a.shape)

    try:
        return climbed(value, principal_axes(x, k), rounds)
    finally:
        shared.destroy()


def rank_by_neighbours(df: DataFrame, columns: Sequence[str], label: str, most: int, **how) -> list[str]:
    """The columns with the greatest weights in the first component."""
    weight = np.abs(neighbour_components(df, columns, label, **how)[0])
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-weight[i], i))[:most]]
