"""The continuity fold on streams: any cut into batches gives what the batch form gives."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals as iv
from pulsegrid.streaming import bouts

LEAST, LAPSE, TOLERANCE = 8, 20, 4


def recording(rng, n):
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([1, 2, 3, 4, 5, 9, 25])
        size = rng.choice([1, 2, 3, 5, 9, 12])
        out.append((at, at + size))
        at += size
    return out


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_any_cut_equals_batch(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = sorted((s, e, rec) for rec in ("a", "b", "c") for s, e in recording(rng, 60))
    end = max(e for _, e, _ in rows)
    data = [(rec, s, e) for s, e, rec in rows] + [("a", None, 5)]
    frame = lambda part: spark.createDataFrame(part, "rec string, start long, end_excl long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("end_excl", F.lit(0))))
    # a last row of another recording, far ahead, moves the watermark on, so that timers end what is still open
    parts = [data[i * len(data) // cuts : (i + 1) * len(data) // cuts] for i in range(cuts)] + [[("z", end + 10_000, end + 10_001)], [("z", end + 20_000, end + 20_001)]]
    query = None
    for i, part in enumerate(parts):
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame(part).schema).parquet(f"{tmp_path}/in")
        folded = bouts.continuity(stream, LEAST, LAPSE, TOLERANCE, "ts", 1.0, "60 seconds")  # ends of bouts are out of order by less
        query = folded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, i
    got = iv.merge(spark.read.parquet(f"{tmp_path}/out"))
    want = iv.continuity(frame(data).where("start is not null").select("rec", "start", "end_excl"), LEAST, LAPSE, TOLERANCE)
    assert sorted(map(tuple, got.where("rec <> 'z'").select("rec", "start", "end_excl").collect())) == sorted(map(tuple, want.select("rec", "start", "end_excl").collect()))
