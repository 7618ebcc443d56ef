"""The driver's tables in the role of recordings.

A user is a recording, its events in time order are samples 0..n-1, `value` is the signal. Purchases are button
presses, errors are body movement, clicks, views and signups are the sensor channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ("click", "view", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, idx, kind, x)"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("event_type").alias("kind"), F.col("value").alias("x"))


def lengths(s: DataFrame) -> DataFrame:
    return s.groupBy("rec").agg(F.count("*").alias("n"))


#: The same in SQL: ev(rec, idx, kind, x) and len(rec, n).
EV = """ev AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS kind, value AS x FROM events),
len AS (SELECT rec, count(*) AS n FROM ev GROUP BY rec)"""


def runs_sql(name: str, where: str, source: str = "ev", by: str = "rec") -> str:
    """CTE: runs of the samples that fulfil a condition."""
    return f"""{name} AS (SELECT {by}, min(idx) AS s, max(idx) + 1 AS e FROM (SELECT {by}, idx, idx - row_number() OVER (PARTITION BY {by} ORDER BY idx) AS g FROM {source} WHERE {where}) GROUP BY {by}, g)"""


def merge_sql(name: str, source: str, slack: int = 0, by: str = "rec") -> str:
    """CTE: union of the intervals of a relation."""
    return f"""{name} AS (SELECT {by}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT {by}, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack} THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {by}, g)"""


def cells_sql(name: str, source: str) -> str:
    """CTE: the samples under the intervals of a relation."""
    return f"{name} AS (SELECT DISTINCT rec, unnest(range(s, e)) AS idx FROM {source})"


OUT = "SELECT rec, s AS start, e AS end_excl FROM"
