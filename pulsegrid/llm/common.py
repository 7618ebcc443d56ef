"""What the operators share: words, the checkpoint folder, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D; `bytes.split()` cuts UTF-8 just so.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH_BYTES = "67108864b"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_list(text: str | None) -> list[bytes]:
    return utf8(text).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; only a local session without one gets a folder of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


class Scratch:
    """Tables of one computation, in a folder of their own below the shared one; the folder goes when the computation ends.

    Called with a DataFrame it writes it down and reads it again: what is used many times is computed once, lineage is
    cut, and lost executors lose nothing. `result` writes what outlives the computation.
    """

    def __init__(self, spark: SparkSession):
        shared_folder(spark)
        self.spark, self.n = spark, 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        table = self._written(df, path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, table: DataFrame) -> None:
        """Removes a table that this computation reads no more; it must have been returned by this object."""
        self._delete(self.paths.pop(id(table))[1])

    def result(self, df: DataFrame) -> DataFrame:
        return self._written(df, f"{self.folder.replace('/scratch-', '/result-')}-{uuid.uuid4().hex}")


def small_batches(spark: SparkSession, most: str = "1m") -> None:
    """Texts go to Python in Arrow batches of a megabyte, not of 10,000 rows, so a worker's memory does not follow their
    lengths. A setting of the session, and kept, as plans are made when they run; one that the user has made stays."""
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
