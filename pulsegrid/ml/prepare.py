"""Normalising, feature ranking and votes, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extra_trees import ExtraTrees


def fit_mean_range(features: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, range) of the columns that have no null or NaN, by one pass. A range of 0 counts as 1e-8."""
    bad = lambda c: F.max(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0))
    row = features.agg(F.array(*(F.avg(c) for c in columns)).alias("m"), F.array(*((F.max(c) - F.min(c)).cast("double") for c in columns)).alias("r"), F.array(*(bad(c) for c in columns)).alias("bad")).first()
    return {c: (m, r or 1e-8) for c, m, r, b in zip(columns, row.m, row.r, row.bad, strict=True) if not b and m is not None}


def mean_range(features: DataFrame, fitted: dict[str, tuple[float, float]], keep: Sequence[str] = ()) -> DataFrame:
    """Columns `keep`, and scaled columns in place of the fitted ones; those left out in fitting are dropped, here and in prediction."""
    return features.select(*keep, *((F.col(c) - m).__truediv__(r).alias(c) for c, (m, r) in fitted.items()))


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def rank_by_trees(df: DataFrame, columns: Sequence[str], label: str, most: int) -> list[str]:
    """Greatest gains of boosted stumps of depth 3."""
    model = GBTClassifier(labelCol=label, maxDepth=3, maxIter=20, stepSize=0.1, seed=0).fit(assembled(df, columns))
    gain = model.featureImportances.toArray()
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-gain[i], i))[:most]]


def rank_by_lasso(df: DataFrame, columns: Sequence[str], label: str, most: int) -> list[str]:
    """Columns with the greatest coefficients of an L1 logistic regression, none of them zero."""
    model = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=0.01).fit(assembled(df, columns))
    size = abs(model.coefficients.toArray())
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-size[i], i))[:most] if size[i] > 0]


def rank_by_elimination(df: DataFrame, columns: Sequence[str], label: str, most: int, step: int = 1, extra: bool = False) -> list[str]:
    """Drop the least important column of a random forest, or of extra-trees, until `most` are left."""
    left = list(columns)
    while len(left) > most:
        if extra:
            gain = ExtraTrees(trees=20, depth=5).fit(assembled(df.withColumn("label", F.col(label)).withColumn("weight", F.lit(1.0)), left)).importances
        else:
            gain = RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=5, seed=0).fit(assembled(df, left)).featureImportances.toArray()
        drop = set(sorted(range(len(left)), key=lambda i: (gain[i], -i))[: min(step, len(left) - most)])
        left = [c for i, c in enumerate(left) if i not in drop]
    return left


def voted(ranked: DataFrame, least: int) -> DataFrame:
    """Features that at least `least` rankers name; ranked has (ranker, feature)."""
    return ranked.groupBy("feature").agg(F.countDistinct("ranker").alias("votes")).where(F.col("votes") >= least)


def stratified_folds(rows: DataFrame, label: str, key: str, k: int, ratio: float | None = None, seed: int = 0, order: Column | None = None, span: int = 512) -> DataFrame:
    """Column fold: rows of each class, in a seeded order, cut in k equal parts, the rest to the last.

    ratio under-samples negatives to that many per positive first. Ranks are taken within hash buckets and offset by
    the buckets' sizes, so that no class is sorted in one task. `order` gives an order of one's own in place of the seeded
    one, in buckets of `span` of its values; ties go by key.
    """
    mixed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key) if order is None else order)
    mixed = mixed.withColumn("_b", F.pmod(F.shiftright("_h", 8), F.lit(256)) if order is None else F.floor(F.col("_h") / span))
    sizes = mixed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
    ranked = mixed.withColumn("_r", within).join(F.broadcast(starts), [label, "_b"]).withColumn("_r", F.col("_r") + F.col("_start"))
    if ratio is not None:
        positives = rows.where(F.col(label) == 1).count()
        ranked = ranked.where((F.col(label) == 1) | (F.col("_r") < int(ratio * positives)))
    sizes = ranked.groupBy(label).agg(F.count("*").alias("_n"))
    each = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return ranked.join(F.broadcast(sizes), label).withColumn("fold", F.least(F.floor(F.col("_r") / each), F.lit(k - 1)).cast("int")).select(*rows.columns, "fold")


def probability_of_one(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn("score", F.get(vector_to_array(column), F.lit(1)))
