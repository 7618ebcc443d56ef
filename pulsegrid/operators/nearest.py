"""Exact nearest neighbours of a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distances are compared after rounding to this many digits; ties go to the smaller id.
DIGITS = 6


def block_best(names: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, at_once: int = 256) -> Iterator[tuple]:
    """(ids, distances) of the k nearest rows of each query, by itself excepted; rows in order of their ids.

    One matrix product bounds all distances of some queries. Rows that the bound cannot exclude, ties among them, are
    measured again term by term, so that the answer does not hang on the product's rounding.
    """
    norms = (x * x).sum(1)
    for a in range(0, len(asked), at_once):
        part = q[a : a + at_once]
        square = np.maximum(norms - 2 * part @ x.T + (part * part).sum(1)[:, None], 0)
        square[asked[a : a + at_once, None] == names] = np.inf
        last = np.partition(square, k - 1, axis=1)[:, k - 1] if k <= len(names) else np.full(len(part), np.inf)
        # what rounding of the product and of the compared digits can hide
        slack = 1e-9 * (norms.max() + (part * part).sum(1) + 1)
        bound = (np.sqrt(last + slack) + 2 * 10.0**-DIGITS) ** 2 + slack
        for i in range(len(part)):
            near = np.flatnonzero(square[i] <= bound[i])
            near = near[names[near] != asked[a + i]]
            d = np.sqrt(((x[near] - part[i]) ** 2).sum(1)).round(DIGITS)
            take = np.argsort(d, kind="stable")[:k]
            yield names[near[take]], d[take]


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 8_192, rows_at_once: int = 16_384) -> DataFrame:
    """(key, near, dist, k): the k nearest rows of each query, itself excepted, ranked by distance and id.

    Queries and rows are dealt to blocks of bounded size by a hash of the key; every pair of blocks is a group that gives
    each of its queries the k nearest of its rows, and the nearest of those win. A row is sent once per block of queries.
    Nothing goes through the driver but two counts. Rows without a key or a vector take no part; no rows give none.
    """
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull()
    asked, v = (d.where(whole).select(F.col(key).alias("key"), F.col(vector).alias("vector")) for d in (queries, rows))
    across, down = max(1, -(-asked.count() // block)), max(1, -(-v.count() // rows_at_once))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = asked.select("*", own(across).alias("q")).select("*", every(down).alias("r"))
    right = v.select("*", own(down).alias("r")).select("*", every(across).alias("q"))

    def best(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"key": [], "near": [], "dist": []}).astype({"key": "int64", "near": "int64", "dist": "float64"})
        if not len(ask) or not len(rows):
            return empty
        rows = rows.sort_values("key")
        names, x = rows["key"].to_numpy(), np.array(rows["vector"].tolist(), float)
        ids = ask["key"].to_numpy()
        found = block_best(names, x, ids, np.array(ask["vector"].tolist(), float), k)
        return pd.concat([empty, *(pd.DataFrame({"key": i, "near": n, "dist": d}) for i, (n, d) in zip(ids, found, strict=True))])

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, "key long, near long, dist double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("dist", "near"))
    return found.withColumn("k", rank.cast("long")).where(F.col("k") <= k).withColumnRenamed("key", key)
