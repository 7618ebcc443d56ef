"""What was fitted, written down and read back: normalising, chosen columns, models, stage parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

import yaml
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Base
from .boosting import AdaBoostModel, RealBoostModel
from .ensemble import NearestRowsModel
from .extra_trees import ExtraTreesModel
from .prepare import mean_range


def save_processor(spark: SparkSession, fitted: dict[str, tuple[float, float]], ranked: Sequence[str], path: str) -> None:
    """Mean and range by column in their order, and the rank of the columns that were chosen (null for the others)."""
    rank = {c: i for i, c in enumerate(ranked)}
    rows = [(i, c, float(m), float(r), rank.get(c)) for i, (c, (m, r)) in enumerate(fitted.items())]
    spark.createDataFrame(rows, "place int, name string, mean double, spread double, rank int").coalesce(1).write.mode("overwrite").parquet(path)


def load_processor(spark: SparkSession, path: str) -> tuple[dict[str, tuple[float, float]], list[str]]:
    rows = spark.read.parquet(path).orderBy("place").collect()  # one row per column of features
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    return {r["name"]: (r["mean"], r["spread"]) for r in rows}, [r["name"] for r in ranked]


def processed(features: DataFrame, keys: Sequence[str], fitted: dict[str, tuple[float, float]], ranked: Sequence[str]) -> DataFrame:
    """The keys and the chosen columns, scaled as they were in training."""
    known = {c: fitted[c] for c in ranked}
    scaled = mean_range(features.select(*known), known).columns
    return features.select(*keys, *((F.col(c) - known[c][0]).__truediv__(known[c][1]).alias(c) for c in scaled))


#: Models of this library by the name that is stored with them; all others are Spark's.
KINDS = {"adaboost": AdaBoostModel, "real-boost": RealBoostModel, "extra-trees": ExtraTreesModel, "nearest-rows": NearestRowsModel}


def save_models(models: dict[str, object], path: str) -> None:
    """Each model in a folder of its name, with its kind: Spark's own in its format, others as tables."""
    spark = SparkSession.active()
    for name, model in models.items():
        kind = next((k for k, c in KINDS.items() if isinstance(model, c)), "spark")
        if kind == "spark":
            model.write().overwrite().save(f"{path}/{name}/model")
        elif kind in ("extra-trees", "nearest-rows"):
            model.save(spark, f"{path}/{name}/model")
        else:
            model.save(f"{path}/{name}/model")
        spark.createDataFrame([(kind,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/kind")


def load_model(spark: SparkSession, path: str):
    kind = spark.read.text(f"{path}/kind").first().value
    return KINDS[kind].load(spark, f"{path}/model") if kind in KINDS else DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


def config_text(stages: dict[str, Base]) -> str:
    """Stage parameters as YAML that config.read takes back."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

    return yaml.safe_dump({"data_pipeline": {name: plain(asdict(stage)) for name, stage in stages.items()}}, sort_keys=False)
