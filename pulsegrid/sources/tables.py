"""Manifests, file lists, incremental feature stores, result and evaluation sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, dat_file_key, csv_file_key) of a manifest's items; a missing CSV key is the data key's name with .csv."""
    raw = spark.read.schema("version string, items array<struct<bucketName:string,datFileKey:string,csvFileKey:string>>").json(path, multiLine=True)
    item = raw.select(F.explode("items").alias("i"))
    fallback = F.regexp_replace("i.datFileKey", r"\.dat$", ".csv")
    return item.select(F.col("i.bucketName").alias("bucket"), F.col("i.datFileKey").alias("dat_file_key"), F.coalesce("i.csvFileKey", fallback).alias("csv_file_key"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the lines of a .txt file that are not blank, or the one file itself."""
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return spark.createDataFrame([(path,)], "path string")


def missing(manifest: DataFrame, store: DataFrame | None, force: bool = False) -> DataFrame:
    """Items without features yet."""
    if force or store is None:
        return manifest
    return manifest.join(store.select("dat_file_key").distinct(), "dat_file_key", "left_anti")


def append_features(features: DataFrame, path: str) -> None:
    """features has dat_file_key, start_indices, end_indices, labels, feature_set and the named columns."""
    features.write.mode("append").partitionBy("feature_set").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    columns = ("dat_file_key", "start_indices", "end_indices", "predictions", "prediction_scores")
    predictions.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "dat_file_key string, start_indices long, end_indices long, predictions int, prediction_scores double"
    return spark.read.schema(schema).option("header", True).csv(path)


def valid_predictions(predictions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Positive predictions whose ends lie in the recording, as intervals; joined by file key, not by place."""
    p = predictions.where("predictions = 1").join(lengths.withColumnRenamed("rec", "dat_file_key"), "dat_file_key")
    p = p.where("start_indices >= 0 and start_indices < n and end_indices >= 0 and end_indices <= n and start_indices < end_indices")
    return p.select(F.col("dat_file_key").alias("rec"), F.col("start_indices").alias("start"), F.col("end_indices").alias("end_excl"))


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").option("header", True).csv(path)


def evaluation_json(metrics: DataFrame) -> DataFrame:
    """One JSON document of the overall metrics (the row without a recording)."""
    names = [c for c in metrics.columns if c != "rec"]
    values = F.struct(*(F.struct(F.col(c).alias("value")).alias(c) for c in names))
    return metrics.where("rec is null").select(F.to_json(F.struct(values.alias("classification_metrics"))).alias("value"))
