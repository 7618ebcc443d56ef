"""Alignment of sparse channels to the dense sample axis, and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm


def dense_axis(recordings: DataFrame, length: str = "n") -> DataFrame:
    """(rec, idx) for idx in 0..n-1."""
    return recordings.where(F.col(length) > 0).select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)).alias("idx"))


def scatter(axis: DataFrame, sparse: DataFrame, *columns: str) -> DataFrame:
    """Sparse values on the dense axis; samples without a value are 0."""
    return axis.join(sparse.select("rec", "idx", *columns), ["rec", "idx"], "left").fillna(0, list(columns))


def interpolated(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    """Linear interpolation of channels with nulls between their known samples, constant beyond the first and last.

    names: channel to the name of its result. The known sample before is a running last value, the one ahead a running
    last value from the other end: two sorts for all channels, and work in proportion to the samples.
    """
    rec = Window.partitionBy("rec")
    known = {c: F.when(F.col(c).isNotNull(), F.struct("idx", F.col(c).alias("v"))) for c in names}
    so_far = lambda order, c: F.last(known[c], ignorenulls=True).over(rec.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = samples.withColumns({f"_a_{c}": so_far(F.col("idx"), c) for c in names}).withColumns({f"_b_{c}": so_far(F.desc("idx"), c) for c in names})

    def value(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = a["v"] + (b["v"] - a["v"]) * (F.col("idx") - a["idx"]) / (b["idx"] - a["idx"])
        return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["idx"] == b["idx"]), a["v"]).otherwise(line)

    return out.withColumns({name: value(c) for c, name in names.items()}).drop(*(f"_{x}_{c}" for c in names for x in "ab"))


def interpolate(samples: DataFrame, column: str, name: str) -> DataFrame:
    return interpolated(samples, {column: name})


def filled(column: Column) -> Column:
    """Forward fill of nulls, then back fill of leading ones, within a recording; leading ones all take its first known value."""
    order = Window.partitionBy("rec").orderBy("idx")
    forward = F.last(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(forward, first)


def unit_quaternions(samples: DataFrame, parts: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Each row divided by its norm; rows of zeros take the first row that is not, if there is one."""
    length = norm(*(F.col(p) for p in parts))
    whole = Window.partitionBy("rec").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = samples.withColumn("_q", F.when(length > 0, F.struct(*((F.col(p) / length).alias(p) for p in parts))))
    unit = unit.withColumn("_q", F.coalesce("_q", F.first("_q", ignorenulls=True).over(whole)))
    return unit.select(*(c for c in samples.columns if c not in parts), *(F.coalesce(F.col("_q")[p], F.lit(0.0)).alias(p) for p in parts))


def trim_edges(samples: DataFrame, fs: float, keep_short: bool = False) -> DataFrame:
    """Drop 30 s at either end of recordings over 300 s, else 5 s, and renumber. keep_short leaves one that is too short as it is."""
    n = F.count("*").over(Window.partitionBy("rec"))
    cut = F.when(n / fs > 300, int(30 * fs)).otherwise(int(5 * fs))
    out = samples.withColumn("_n", n).withColumn("_p", cut)
    whole = (F.col("_n") <= 2 * F.col("_p")) if keep_short else F.lit(False)
    inside = (F.col("idx") >= F.col("_p")) & (F.col("idx") < F.col("_n") - F.col("_p"))
    out = out.where(whole | inside).withColumn("idx", F.when(whole, F.col("idx")).otherwise(F.col("idx") - F.col("_p")))
    return out.drop("_n", "_p")
