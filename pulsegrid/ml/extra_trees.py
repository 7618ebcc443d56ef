"""Extremely randomised trees: a forest that grows level by level, with cut points drawn at random.

Every node looks at a few columns drawn for it and at one cut of each, uniform between the least and greatest value
that the node's rows have there, and takes the cut that lowers the Gini impurity most. A level of all trees is two passes over
the rows: ranges, then weights left of each cut; both are added up within tasks first, so what is
shuffled and gathered is bounded by the forest, not by the rows. Trees take all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

NODE = "tree int, node int, feature int, cut double, one double"


@dataclass
class Forest:
    """Heaps of nodes, the root at 1: the column that each cuts (-1: a leaf), where, and its share of class one."""

    feature: np.ndarray
    cut: np.ndarray
    one: np.ndarray

    @classmethod
    def bare(cls, trees: int, depth: int) -> Forest:
        size = 1 << (depth + 1)
        return cls(np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size)))

    def at(self, x: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node that each row reaches in so many steps at most."""
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            column = self.feature[tree][node]
            node = np.where(column >= 0, 2 * node + (x[rows, column] > self.cut[tree][node]), node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        levels = int(math.log2(self.feature.shape[1]))
        return np.mean([self.one[t][self.at(x, t, levels)] for t in range(len(self.feature))], axis=0)


def drawn(seed: int, tree: int, node: int, columns: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that a node looks at, and where between their ends it cuts them."""
    rng = np.random.default_rng([seed, tree, node])
    return rng.permutation(columns)[:most], rng.random(most)


def gini(weights: np.ndarray) -> np.ndarray:
    """Impurity of (class 0, class 1) weights, times their sum."""
    total = weights.sum(-1)
    return total - (weights**2).sum(-1) / np.where(total > 0, total, 1)


@dataclass
class ExtraTrees:
    trees: int = 50
    depth: int = 6
    columns: int | None = None  # the root of their number
    least_gain: float = 1e-9
    seed: int = 0

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        """On features (vector), label (0 or 1) and weight. Rows without a label are left out; no rows give a forest that says 0."""
        rows = settled(df.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), F.col("weight").cast("double").alias("w")))
        first = rows.select(F.size("x").alias("n")).first()
        forest = Forest.bare(self.trees, self.depth)
        if first is None:
            return ExtraTreesModel(forest, np.zeros(0))
        width = first.n
        most = min(self.columns or max(1, math.isqrt(width)), width)
        totals = rows.groupBy("y").agg(F.sum("w").alias("w")).collect()
        whole = np.array([sum(r.w for r in totals if r.y == c) for c in (0, 1)])
        weights = {(t, 1): whole for t in range(self.trees)}
        gains = np.zeros(width)
        for level in range(self.depth + 1):
            for (t, n), w in weights.items():
                forest.one[t, n] = w[1] / w.sum() if w.sum() > 0 else 0.0
            growing = {k: w for k, w in weights.items() if level < self.depth and w.min() > 0}
            if not growing:
                break
            looks = {k: drawn(self.seed, *k, width, most) for k in growing}
            low, high = self.ranges(rows, forest, level, looks)
            cuts = {k: low[k] + looks[k][1] * (high[k] - low[k]) for k in growing}
            left = self.weights_left(rows, forest, level, looks, cuts)
            weights = {}
            for (t, n), w in growing.items():
                gain = np.where(high[t, n] > low[t, n], gini(w) - gini(left[t, n]) - gini(w - left[t, n]), 0)
                j = int(gain.argmax())
                if gain[j] <= self.least_gain:
                    continue
                forest.feature[t, n], forest.cut[t, n] = looks[t, n][0][j], cuts[t, n][j]
                gains[looks[t, n][0][j]] += gain[j] / whole.sum()
                weights |= {(t, 2 * n): left[t, n][j], (t, 2 * n + 1): w - left[t, n][j]}
        return ExtraTreesModel(forest, gains / max(gains.sum(), 1e-300))

    @staticmethod
    def summed(rows: DataFrame, forest: Forest, level: int, looks: dict, start: float, names: list[str], add: Callable, totals: list) -> dict:
        """One pass: `add` puts a batch into arrays (names, trees, nodes of the level, looks), which tasks emit and Spark adds up."""
        base, most = 1 << level, len(next(iter(looks.values()))[0])
        trees = sorted({t for t, _ in looks})
        columns = np.full((len(forest.feature), base, most), -1)
        for (t, n), (which, _) in looks.items():
            columns[t, n - base] = which

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.full((len(names), len(forest.feature), base, most), start)
            for batch in (b for b in batches if len(b)):
                x, y, w = np.array(batch["x"].tolist(), float), batch["y"].to_numpy(), batch["w"].to_numpy()
                for t in trees:
                    k = forest.at(x, t, level) - base
                    here = np.flatnonzero(k >= 0)
                    here = here[columns[t, k[here], 0] >= 0]
                    if len(here):
                        add(held[:, t], k[here], x[here[:, None], columns[t, k[here]]], y[here], w[here], t)
            t, n = np.nonzero(columns[:, :, 0] >= 0)
            for j in range(most):
                yield pd.DataFrame({"tree": t, "node": n + base, "look": j} | {name: held[i, t, n, j] for i, name in enumerate(names)})

        schema = "tree int, node int, look int, " + ", ".join(f"{n} double" for n in names)
        out = {k: np.empty((len(names), most)) for k in looks}
        for r in rows.mapInPandas(run, schema).groupBy("tree", "node", "look").agg(*(f(n).alias(n) for f, n in zip(totals, names, strict=True))).collect():
            out[r.tree, r.node][:, r.look] = [r[n] for n in names]
        return out

    def ranges(self, rows: DataFrame, forest: Forest, level: int, looks: dict) -> tuple[dict, dict]:
        def add(held, k, values, y, w, t):
            for j in range(values.shape[1]):
                np.minimum.at(held[0, :, j], k, values[:, j])
                np.minimum.at(held[1, :, j], k, -values[:, j])

        got = self.summed(rows, forest, level, looks, np.inf, ["low", "high"], add, [F.min, F.min])
        return {k: v[0] for k, v in got.items()}, {k: -v[1] for k, v in got.items()}

    def weights_left(self, rows: DataFrame, forest: Forest, level: int, looks: dict, cuts: dict) -> dict:
        base = 1 << level
        table = np.zeros((len(forest.feature), base, len(next(iter(cuts.values())))))
        for (t, n), c in cuts.items():
            table[t, n - base] = c

        def add(held, k, values, y, w, t):
            goes = values <= table[t, k]
            for c in (0, 1):
                for j in range(values.shape[1]):
                    on = goes[:, j] & (y == c)
                    held[c, :, j] += np.bincount(k[on], w[on], base)

        got = self.summed(rows, forest, level, looks, 0.0, ["zero", "one"], add, [F.sum, F.sum])
        return {k: v.T for k, v in got.items()}


class ExtraTreesModel:
    def __init__(self, forest: Forest, importances: np.ndarray):
        self.forest, self.importances = forest, importances

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (vector) and prediction."""
        shared = df.sparkSession.sparkContext.broadcast(self.forest)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(np.array(x.tolist(), float)) if len(x) else [], dtype=float)

        one = score(vector_to_array("features"))
        scored = df.withColumn("_one", one)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_one"), F.col("_one")))).withColumn("prediction", (F.col("_one") >= 0.5).cast("double")).drop("_one")

    def save(self, spark: SparkSession, path: str) -> None:
        f = self.forest
        rows = [(t, n, int(f.feature[t, n]), float(f.cut[t, n]), float(f.one[t, n])) for t in range(f.feature.shape[0]) for n in range(f.feature.shape[1])]
        spark.createDataFrame(rows, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.importances)], "feature int, importance double").coalesce(1).write.mode("overwrite").parquet(f"{path}/importances")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExtraTreesModel:
        rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        shape = (rows[-1].tree + 1, -1)
        forest = Forest(np.array([r.feature for r in rows], np.int32).reshape(shape), np.array([r.cut for r in rows]).reshape(shape), np.array([r.one for r in rows]).reshape(shape))
        return cls(forest, np.array([r.importance for r in spark.read.parquet(f"{path}/importances").orderBy("feature").collect()]))
