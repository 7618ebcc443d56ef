"""Boosting over weighted rows: each round's tree, or chain of stumps, is fitted where those before it erred.

AdaBoost counts errors (one weight a tree); RealBoost takes the probabilities of leaves into weights and vote.

Trees are Spark ML's, fitted on the whole table; what a round adds is one grouped sum, and one column of weights that is
written down, so that neither plans nor recomputation grow with the rounds.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled


class AdaBoost:
    """Two classes, 0 and 1; a round whose tree is no better than chance ends the fit, a tree without errors too."""

    def __init__(self, rounds: int = 10, depth: int = 1, rate: float = 1.0, label: str = "label", weight: str = "weight"):
        self.rounds, self.depth, self.rate, self.label, self.weight = rounds, depth, rate, label, weight

    def fit(self, df: DataFrame) -> AdaBoostModel:
        trees, alphas = [], []
        rows = settled(df.select("features", self.label, F.col(self.weight).cast("double").alias("_w")))
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(labelCol=self.label, weightCol="_w", maxDepth=self.depth, seed=i).fit(rows)
            judged = tree.transform(rows).withColumn("_miss", (F.col("prediction") != F.col(self.label)).cast("double"))
            sums = judged.agg(F.sum("_w").alias("all"), F.sum(F.col("_w") * F.col("_miss")).alias("missed")).first()
            error = (sums["missed"] or 0.0) / sums["all"] if sums["all"] else 0.5
            if error >= 0.5:
                break
            alpha = self.rate * 0.5 * math.log((1 - error) / max(error, 1e-6))
            trees.append(tree)
            alphas.append(alpha)
            if error < 1e-6:
                break
            # weights of one sum at all times
            grown = F.col("_w") * F.exp(alpha * (2 * F.col("_miss") - 1)) / (2 * math.sqrt(error * (1 - error)) if self.rate == 1.0 else 1.0)
            rows = settled(judged.select("features", self.label, grown.alias("_w")))
        return AdaBoostModel(trees, alphas)


class AdaBoostModel:
    def __init__(self, trees: list, alphas: list[float]):
        self.trees, self.alphas = trees, alphas

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction and probability: the logistic of twice the weighted vote. Without trees all is 0.5."""
        out, vote = df, F.lit(0.0)
        for i, (tree, alpha) in enumerate(zip(self.trees, self.alphas, strict=True)):
            out = tree.copy().setPredictionCol(f"_p{i}").setProbabilityCol("").setRawPredictionCol("").transform(out)
            vote = vote + alpha * (2 * F.col(f"_p{i}") - 1)
        one = 1 / (1 + F.exp(-2 * vote))
        probability = array_to_vector(F.array(1 - one, one))
        return out.withColumn("probability", probability).withColumn("prediction", (one >= 0.5).cast("double")).drop(*(f"_p{i}" for i in range(len(self.trees))))

    def save(self, path: str) -> None:
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree{i:03d}")
        spark = SparkSession.active()
        spark.createDataFrame(list(enumerate(map(float, self.alphas))), "tree int, alpha double").coalesce(1).write.mode("overwrite").parquet(f"{path}/alphas")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AdaBoostModel:
        rows = spark.read.parquet(f"{path}/alphas").orderBy("tree").collect()
        return cls([DecisionTreeClassificationModel.load(f"{path}/tree{r.tree:03d}") for r in rows], [r.alpha for r in rows])


#: Probabilities are kept so far from 0 and 1, so that their logarithms are finite.
LEAST = 2.0**-52


def log_odds(probability: str):
    p = F.least(F.greatest(F.get(vector_to_array(probability), F.lit(1)), F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(p) - F.log(1 - p)


class RealBoost:
    """Boosting by probabilities (SAMME.R for two classes, 0 and 1).

    stumps=0: each round's base is one tree of `depth`; else it is a boosted chain of so many stumps. A round that
    errs nowhere ends the fit. Weights have the mean 1 in every round.
    """

    def __init__(self, rounds: int = 10, depth: int = 1, stumps: int = 0, rate: float = 1.0, label: str = "label", weight: str = "weight"):
        self.rounds, self.depth, self.stumps, self.rate, self.label, self.weight = rounds, depth, stumps, rate, label, weight

    def base(self, seed: int):
        if self.stumps:
            return GBTClassifier(labelCol=self.label, weightCol="_w", maxIter=self.stumps, maxDepth=1, seed=seed)
        return DecisionTreeClassifier(labelCol=self.label, weightCol="_w", maxDepth=self.depth, seed=seed)

    def fit(self, df: DataFrame) -> RealBoostModel:
        models: list = []
        rows = settled(df.select("features", self.label, F.col(self.weight).cast("double").alias("_w")))
        for i in range(self.rounds):
            size = rows.agg(F.sum("_w").alias("all"), F.count("*").alias("n")).first()
            if not size["all"]:
                break
            rows = rows.withColumn("_w", F.col("_w") * (size["n"] / size["all"]))
            models.append(self.base(i).fit(rows))
            judged = models[-1].transform(rows)
            sign = 2 * F.col(self.label) - 1
            grown = F.col("_w") * F.exp(-self.rate / 2 * sign * log_odds("probability"))
            rows = settled(judged.select("features", self.label, grown.alias("_w"), (F.col("prediction") != F.col(self.label)).alias("_miss")))
            if rows.where("_miss").isEmpty():
                break
            rows = rows.drop("_miss")
        return RealBoostModel(models)


class RealBoostModel:
    def __init__(self, models: list):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction and probability: the logistic of the mean log odds. Without rounds all is 0.5."""
        out, n = df, len(self.models)
        for i, model in enumerate(self.models):
            out = model.copy().setPredictionCol("").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").transform(out)
        odds = sum((log_odds(f"_p{i}") for i in range(n)), F.lit(0.0)) / max(n, 1)
        one = 1 / (1 + F.exp(-odds))
        out = out.withColumn("probability", array_to_vector(F.array(1 - one, one))).withColumn("prediction", (one >= 0.5).cast("double"))
        return out.drop(*(f"_{c}{i}" for c in "pr" for i in range(n)))

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/round{i:03d}")
        kind = "stumps" if self.models and isinstance(self.models[0], GBTClassificationModel) else "tree"
        SparkSession.active().createDataFrame([(kind, len(self.models))], "base string, rounds int").coalesce(1).write.mode("overwrite").parquet(f"{path}/rounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RealBoostModel:
        row = spark.read.parquet(f"{path}/rounds").first()
        kind = GBTClassificationModel if row.base == "stumps" else DecisionTreeClassificationModel
        return cls([kind.load(f"{path}/round{i:03d}") for i in range(row.rounds)])
