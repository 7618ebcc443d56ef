"""Structured Streaming: tumbling sums, session bouts, the continuity fold, and recordings taken in as their files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, value: str, width: str, late: str, *keys: str) -> DataFrame:
    """Sum and count per window and key; events over `late` behind the watermark are dropped by Spark."""
    w = F.window(time, width).alias("w")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "n")


def sliding(events: DataFrame, time: str, value: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    w = F.window(time, width, step).alias("w")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Bouts of events less than `gap` apart, by key."""
    w = F.session_window(time, gap).alias("w")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def watch_recordings(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Hand each batch of new files (path, modificationTime, length, content) to `handle`, once, and stop when there are no more."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a recording's fold has to remember: the end of what failed or was kept last, and the chain that is still open.
FOLD = "last long, open boolean, start long, first_end long, end_excl long"


def continuity(bouts: DataFrame, least: int, lapse: int, tolerance: int, time: str, rate: float, late: str) -> DataFrame:
    """rec, start, end_excl: the kept bouts and chains of operators.intervals.continuity, as they are decided, before they are merged.

    bouts(rec, start, end_excl, time): `time` is when a bout ends. A recording's bouts must come in order from
    batch to batch; within a batch they are sorted. State is one row a recording. A chain is decided by the first
    bout that does not join it, or by a timer once the watermark (`late` behind) has passed its end by the tolerance,
    `rate` samples a second; a bout that comes after that starts anew. Null starts or ends are left out.
    """

    def decided(state: list, out: list) -> list:
        """The fold after its open chain has ended."""
        last, on, start, first_end, end = state
        if not on:
            return state
        if end - start > least:
            out.append((start, end))
            return [end, False, 0, 0, 0]
        return [first_end, False, 0, 0, 0]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = list(held.get) if held.exists else [-lapse, False, 0, 0, 0], []
        if held.hasTimedOut:
            state = decided(state, out)
        newest = 0
        frames = [b for b in batches if len(b)]
        for row in pd.concat(frames).sort_values(["start", "end_excl"]).itertuples() if frames else ():
            begin, end = int(row.start), int(row.end_excl)
            newest = max(newest, int(getattr(row, time).timestamp() * 1000))
            if state[1] and begin - state[4] <= tolerance:
                state[4] = end
                continue
            state = decided(state, out)
            if end - begin > least:
                out.append((begin, end))
            elif end - state[0] > lapse:
                state = [state[0], True, begin, end, end]
            else:
                state[0] = end
        held.update(tuple(state))
        if state[1] and newest:
            held.setTimeoutTimestamp(max(newest + int(1000 * tolerance / rate), held.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame({"rec": key[0], "start": [a for a, _ in out], "end_excl": [b for _, b in out]})

    rows = bouts.where("start is not null and end_excl is not null").withWatermark(time, late).select("rec", "start", "end_excl", time)
    kind = rows.schema["rec"].dataType.simpleString()
    return rows.groupBy("rec").applyInPandasWithState(run, f"rec {kind}, start long, end_excl long", FOLD, "append", GroupStateTimeout.EventTimeTimeout)
