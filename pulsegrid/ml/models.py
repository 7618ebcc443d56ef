"""Classifiers by name, cross-validated fits, out-of-fold predictions and soft voting.

Every model is a Spark ML estimator with probabilities; a kernel machine is random Fourier features under a linear
one; extra-trees, boosting by probabilities and nearest rows are this library's own. Scores need not equal those of other
libraries' solvers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import RealBoost
from .ensemble import NearestRows
from .extra_trees import ExtraTrees
from .prepare import probability_of_one


def registry(inputs: int) -> dict[str, Callable]:
    """Name to a fresh estimator for `inputs` features."""
    return {
        "log-regression": lambda: LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-3),
        "random-forest": lambda: RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=50, maxDepth=6, impurity="entropy", seed=0),
        "extra-trees": lambda: ExtraTrees(trees=50, depth=6),
        "adaboost": lambda: RealBoost(rounds=4, stumps=4),
        "nearest-rows": lambda: NearestRows(k=5),
        "gradient-boosting": lambda: GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=3, seed=0),
        "neural-net": lambda: MultilayerPerceptronClassifier(labelCol="label", layers=[inputs, 16, 2], maxIter=60, seed=0),
        "svm": lambda: LogisticRegression(labelCol="label", weightCol="weight", featuresCol="fourier", regParam=1e-3),
    }


def fourier_features(df: DataFrame, inputs: int, size: int = 64, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Random Fourier features of an RBF kernel, in the vector column `fourier`."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (size, inputs)), rng.uniform(0, 2 * np.pi, size)
    x = vector_to_array("features")
    cosines = [F.cos(F.aggregate(F.zip_with(x, F.array(*map(F.lit, row.tolist())), lambda a, c: a * c), F.lit(float(shift)), lambda s, v: s + v)) * float(np.sqrt(2 / size)) for row, shift in zip(w, b, strict=True)]
    return df.withColumn("fourier", array_to_vector(F.array(*cosines)))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight 1 for negatives, negatives per positive for positives."""
    ratio = class_ratio(df, label).select(F.coalesce("weight_of_one", F.lit(1.0)).alias("_w"))
    return df.crossJoin(F.broadcast(ratio)).withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0)).drop("_w")


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: negatives per positive, null if there is no positive."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("weight_of_one"))


def out_of_fold(df: DataFrame, make: Callable, folds: Sequence[int]) -> DataFrame:
    """Union of each fold's predictions by a model fitted on the others; columns of df, prediction and score."""
    parts = []
    for f in folds:
        model = make().fit(df.where(F.col("fold") != f))
        parts.append(probability_of_one(model.transform(df.where(F.col("fold") == f))))
    return reduce(DataFrame.unionByName, parts)


def tune(df: DataFrame, estimator, grid: dict[str, Sequence], fold_col: str = "fold"):
    """Best of a parameter grid by F1 over the given folds; returns the cross-validated model."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(estimator.getParam(name), list(values))
    folds = df.agg(F.max(fold_col)).first()[0] + 1
    scorer = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=scorer, numFolds=folds, foldCol=fold_col, parallelism=2).fit(df)


def best_fold(df: DataFrame, make: Callable, folds: Sequence[int]) -> tuple[int, object]:
    """The fold whose model, fitted on the others, has the greatest F1 on it (the first of equals), and that model."""
    best = None
    for f in folds:
        model = make().fit(df.where(F.col("fold") != f))
        row = scores(probability_of_one(model.transform(df.where(F.col("fold") == f)))).first()
        f1 = row.f1 if row is not None else 0.0
        if best is None or f1 > best[0]:
            best = (f1, f, model)
    return best[1], best[2]


def soft_vote(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score over members (column model), and 1 where it is 0.5 or more."""
    out = predictions.groupBy(*keys).agg(F.avg("score").alias("score"))
    return out.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def scores(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and F1 by fold."""
    p, y = F.col("prediction") == 1, F.col(label) == 1
    tp, fp, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y)
    return predictions.groupBy("fold").agg(F.avg((p == y).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def area_under_curve(predictions: DataFrame, label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=label).evaluate(predictions)


def passes_gate(f1: float, least: float = 0.55) -> bool:
    return f1 >= least
