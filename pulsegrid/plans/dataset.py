"""From a manifest of recordings to a feature store.

The store has two tables, both partitioned by a digest of the file key and written by dynamic partition overwrite:
`features`, and `files` with a row per file, its number of detections or its error. A file's row is written after its
features and names the run that wrote them, so a build that was stopped, or runs again, adds and repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Base
from ..session import settled
from ..sources import recordings
from . import detection

FILES = "dat_file_key string, error string, n_detections long, run string, file string"


def read_files(spark: SparkSession, store: str) -> DataFrame:
    """(dat_file_key, error, n_detections, run): files that were tried; error is null where features were made."""
    try:
        return spark.read.schema(FILES).parquet(f"{store}/files").drop("file")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES).drop("file")


def read_features(spark: SparkSession, store: str) -> DataFrame:
    """Features of the files' last runs. A store without any raises ValueError."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(f"{store}/features").drop("file")
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ValueError(f"no features in {store}: every file failed or has no detections") from gone
    return found.join(read_files(spark, store).where("error is null"), ["dat_file_key", "run"], "left_semi").drop("run")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, dat_file_key) of the files under a folder; contents are not read."""
    base = urlsplit(root).path.rstrip("/") + "/"
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return paths.select("path", F.substr("path", F.instr("path", base) + F.lit(len(base))).alias("dat_file_key"))


def todo(spark: SparkSession, manifest: DataFrame, root: str, store: str, force: bool = False) -> DataFrame:
    """(dat_file_key, path) of the manifest's files without features; path is null where there is no such file.

    Items without a key are skipped and repeated ones count once. Files that failed are tried again.
    """
    wanted = manifest.where("dat_file_key is not null").select("dat_file_key").distinct()
    if not force:
        wanted = wanted.join(read_files(spark, store).where("error is null"), "dat_file_key", "left_anti")
    return wanted.join(listed(spark, root), "dat_file_key", "left")


def build(spark: SparkSession, manifest: DataFrame, root: str, store: str, config: dict[str, Base], force: bool = False, files_at_once: int = 1_000) -> DataFrame:
    """Extract what the store lacks and return its files table.

    Files are taken in portions, each of which is a job of its own and is kept once done; only names go through the
    driver. A file that cannot be read is a row with its error. If a portion fails in a Python stage it is halved until
    the file is found, so that one file's failure costs no other's features.
    """
    if strange := set(config["extract_feat"].feature_sets) - {"crafted"}:
        raise ValueError(f"no feature set {', '.join(sorted(strange))}")
    names = iter(settled(todo(spark, manifest, root, store, force)).toLocalIterator())
    while portion := [(r.dat_file_key, r.path) for r in islice(names, files_at_once)]:
        for files in _portions(spark, portion, store, config):
            part = spark.createDataFrame(files, "dat_file_key string, error string, n_detections long, run string")
            _write(part, f"{store}/files")
    return read_files(spark, store)


def _portions(spark: SparkSession, items: list[tuple[str, str | None]], store: str, config: dict[str, Base]) -> Iterator[list[tuple]]:
    """Rows of the files table for the items, whose features are written by then."""
    here = [(key, path) for key, path in items if path is not None]
    if gone := [(key, "no such file", None, None) for key, path in items if path is None]:
        yield gone
    if not here:
        return
    run = uuid.uuid4().hex
    try:
        yield _extract(spark, here, run, store, config)
    except PythonException as problem:
        if len(here) == 1:
            yield [(here[0][0], str(problem).strip().splitlines()[-1], None, None)]
            return
        middle = len(here) // 2
        yield from _portions(spark, here[:middle], store, config)
        yield from _portions(spark, here[middle:], store, config)


def _extract(spark: SparkSession, items: list[tuple[str, str]], run: str, store: str, config: dict[str, Base]) -> list[tuple]:
    paths = [path for _, path in items]
    keys = spark.createDataFrame(items, "dat_file_key string, rec string")
    read = recordings.read_recordings(spark, paths).select("rec", "error")
    out = detection.detect(recordings.read_samples(spark, paths), config)
    rows = out["features"].join(out["detections"].select("rec", "det_id", F.col("label").alias("labels")), ["rec", "det_id"]).join(keys, "rec")
    rows = rows.withColumnsRenamed({"start": "start_indices", "end_excl": "end_indices"}).drop("rec", "det_id")
    rows = settled(rows.withColumn("feature_set", F.lit("crafted")).withColumn("run", F.lit(run)))
    _write(rows, f"{store}/features")
    found = rows.groupBy("dat_file_key").agg(F.count("*").alias("n"))
    counts = keys.join(read, "rec", "left").join(found, "dat_file_key", "left")
    return [(r.dat_file_key, r.error, None if r.error else r.n or 0, run) for r in counts.select("dat_file_key", "error", "n").toLocalIterator()]


def _write(rows: DataFrame, path: str) -> None:
    dealt = rows.withColumn("file", F.concat(F.lit("f"), F.substring(F.sha2("dat_file_key", 256), 1, 24))).repartition("file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)
