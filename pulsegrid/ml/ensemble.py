"""Nearest neighbours as a classifier, and named members that vote with the mean of their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from .prepare import probability_of_one


def matrix(rows: list, values) -> np.ndarray:
    """A row of values(row) for each row; no rows have no columns."""
    return np.array([values(r) for r in rows], float) if rows else np.empty((0, 0))


#: Fitted rows that are broadcast; more of them stay a table.
MOST_SENT = 50_000
#: Bytes of vectors in a block of fitted rows and in one of asked rows.
ROW_BLOCK, ASKED_BLOCK = 1 << 22, 1 << 20


def nearest_places(asked: np.ndarray, x: np.ndarray, k: int, cells: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, squared distances) of the k nearest rows of x of each asked row; of equally near ones the first in x.

    Distances are rounded to nine digits. About `cells` of them are held at once: the k-th least of the least of some
    stretches of rows bounds what is looked at again.
    """
    squares, n = (x**2).sum(1), len(x)
    at_once, stretch = max(1, min(256, cells // max(n, 1))), max(1, min(64, n // max(4 * k, 1)))
    starts = np.arange(0, n, stretch)
    for i in range(0, len(asked), at_once):
        a = asked[i : i + at_once]
        apart = squares[None, :] - 2 * a @ x.T + (a**2).sum(1)[:, None]
        bound = np.inf if len(starts) < k else np.partition(np.minimum.reduceat(apart, starts, axis=1), k - 1, axis=1)[:, k - 1, None] + 2e-9
        rows, places = np.nonzero(~(apart > bound))
        ends = np.searchsorted(rows, np.arange(len(a) + 1))
        near = apart[rows, places].round(9)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            take = lo + np.argsort(near[lo:hi], kind="stable")[:k]
            yield places[take], near[take]


class NearestRows:
    """The share of ones among the k nearest of the fitted rows (ties: those of least hash).

    Up to MOST_SENT rows are broadcast; more stay a table, and blocks of asked rows meet blocks of them, all of them. Only
    with most_rows are rows left out: those of least hash are kept.
    """

    def __init__(self, k: int = 5, most_rows: int | None = None, seed: int = 0):
        self.k, self.most_rows, self.seed = k, most_rows, seed

    def fit(self, df: DataFrame) -> NearestRowsModel:
        rows = df.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        rows = rows.withColumn("h", F.xxhash64(F.lit(self.seed), "x", "y"))
        if self.most_rows is not None:
            rows = rows.orderBy("h", "x", "y").limit(self.most_rows)
        if rows.limit(MOST_SENT + 1).count() > MOST_SENT:
            return NearestRowsTable(rows.select("h", "x", F.col("y").cast("double").alias("y")), self.k)
        taken = rows.orderBy("h", "x", "y").collect()
        return NearestRowsModel(matrix(taken, lambda r: r.x), np.array([r.y for r in taken], float), self.k)


class NearestRowsModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        self.x, self.y, self.k = x, y, k

    def score(self, asked: np.ndarray, cells: int = 1_000_000) -> np.ndarray:
        """Rows are asked a block at a time, so that about `cells` distances are held at once, however many rows are kept."""
        out = np.zeros(len(asked))
        if not len(self.x):
            return out
        for i, (places, _) in enumerate(nearest_places(asked, self.x, min(self.k, len(self.x)), cells)):
            out[i] = self.y[places].mean()
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(np.array(x.tolist(), float)) if len(x) else [], dtype=float)

        return with_probability(df.withColumn("_one", score(vector_to_array("features"))))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, x, float(y), self.k) for i, (x, y) in enumerate(zip(self.x.tolist(), self.y, strict=True))]
        spark.createDataFrame(rows, "row long, x array<double>, y double, k int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NearestRowsModel:
        table = spark.read.parquet(path)
        rows = table.orderBy("row").take(MOST_SENT + 1)
        if len(rows) > MOST_SENT:
            return NearestRowsTable(table.select(F.col("row").alias("h"), "x", "y"), rows[0].k)
        return NearestRowsModel(matrix(rows, lambda r: r.x), np.array([r.y for r in rows], float), rows[0].k if rows else 1)


def with_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_one"), F.col("_one")))).withColumn("prediction", (F.col("_one") >= 0.5).cast("double")).drop("_one")


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(n, x and the other columns): rows (x array<double>, longs and doubles) in blocks of vectors of `most` bytes at most, each column as bytes."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            parts = {"n": pa.array([table.num_rows], pa.int64())}
            for c in names:
                values = table[c].combine_chunks()
                values = values.flatten() if pa.types.is_list(values.type) else values
                parts[c] = pa.array([values.to_numpy().tobytes()], pa.binary())
            held.clear()
            return pa.RecordBatch.from_pydict(parts)

        for batch in batches:
            while batch.num_rows:
                at_once = max(1, most // (8 * max(1, len(batch.column(names.index("x"))[0]))))
                room = at_once - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) >= at_once:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, "n long, " + ", ".join(f"{c} binary" for c in names))


class NearestRowsTable(NearestRowsModel):
    """Fitted rows (h, x, y) that are too many to be broadcast; h is their order among equally near ones."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k = settled(rows), k

    def transform(self, df: DataFrame) -> DataFrame:
        """Distinct vectors are asked, known by 128 bits of hashes; each meets every block of rows, and the nearest of those win."""
        k, x = self.k, vector_to_array("features")
        names = [F.xxhash64(x, F.lit(seed)).alias(c) for seed, c in ((1, "_a"), (2, "_b"))]
        asked = df.select(*names, x.alias("x")).dropDuplicates(["_a", "_b"])
        # written down, then a block to a task: pairs of blocks are read by the product's tasks, without a shuffle of rows
        left, right = (settled(packed(d, most)) for d, most in ((asked, ASKED_BLOCK), (self.rows, ROW_BLOCK)))
        left, right = (d.repartition(max(1, min(d.count(), 256))) for d in (left, right))
        pairs = left.select(F.col("n").alias("asked"), "_a", "_b", F.col("x").alias("q")).hint("shuffle_replicate_nl").crossJoin(right)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i] for c in batch.schema.names}
                    n, m = row["asked"].as_py(), row["n"].as_py()
                    values = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)  # noqa: B023, E731
                    h, y = values("h", np.int64), values("y", float)
                    order = np.lexsort((y, h))
                    h, y = h[order], y[order]
                    found = list(nearest_places(values("q", float).reshape(n, -1), values("x", float).reshape(m, -1)[order], min(k, m)))
                    places, far = (np.concatenate([f[j] for f in found]) for j in (0, 1))
                    near = pa.StructArray.from_arrays([pa.array(far), pa.array(h[places]), pa.array(y[places])], ["d", "h", "y"])
                    ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(values("_a", np.int64)), pa.array(values("_b", np.int64)), pa.ListArray.from_arrays(ends, near)], ["_a", "_b", "near"])

        found = pairs.mapInArrow(run, "_a long, _b long, near array<struct<d double, h long, y double>>")
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        best = found.groupBy("_a", "_b").agg(best.alias("near")).select("_a", "_b", (F.aggregate("near", F.lit(0.0), lambda s, r: s + r["y"]) / F.size("near")).alias("_one"))
        return with_probability(df.withColumns(dict(zip(("_a", "_b"), names, strict=True))).join(best, ["_a", "_b"], "left").drop("_a", "_b"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows.select(F.col("h").alias("row"), "x", "y", F.lit(self.k).alias("k")).write.mode("overwrite").parquet(path)


class Ensemble:
    """Members by name, each a function that gives an estimator; fitted together, one after the other."""

    def __init__(self, members: dict[str, Callable]):
        self.members = members

    def fit(self, df: DataFrame) -> EnsembleModel:
        return EnsembleModel({name: make().fit(df) for name, make in self.members.items()})


class EnsembleModel:
    """Each row is scored by all members in one pass; store.save_models(model.members, path) keeps it."""

    def __init__(self, members: dict[str, object]):
        self.members = members

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a column score_<member> for each, probability (their mean) and prediction."""
        out, columns = df, []
        for name, model in self.members.items():
            columns.append(f"score_{name.replace('-', '_')}")
            scored = probability_of_one(model.transform(out)).withColumn(columns[-1], F.col("score"))
            out = scored.drop("score", "probability", "prediction", "rawPrediction")
        one = sum((F.col(c) for c in columns), F.lit(0.0)) / max(len(columns), 1)
        return out.withColumn("probability", array_to_vector(F.array(1 - one, one))).withColumn("prediction", (one >= 0.5).cast("double"))
