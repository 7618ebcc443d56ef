"""Joins of intervals without a bucket width, against all pairs; bout tables; their growth."""

import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import hiccup, maps, report
from pulsegrid.operators import intervals as iv

A = [(0, 2, 5), (0, 7, 7), (0, 9, 20), (0, 9, 20), (0, 30, 31), (1, 0, 4), (None, 0, 9), (2, None, 4), (2, 1, None), (3, 5, 6)]
B = [(0, 0, 100), (0, 4, 9), (0, 5, 9), (0, 20, 30), (1, 4, 6), (1, -3, 0), (None, 0, 9), (2, 0, 9), (4, 1, 2)]
ROW = "rec long, start long, end_excl long"


def touch(a, b):
    return None not in (*a, *b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("right", [B, B[1:], []])
def test_overlapping_keeps_nulls_repeats_and_clashing_names(spark, right):
    a = spark.createDataFrame(A, ROW).withColumns({"_at": F.col("start"), "_row": F.lit("x"), "_value": F.lit(1)})
    b = spark.createDataFrame(right, ROW).withColumn("_at", F.lit("other type"))
    order = lambda rows: sorted(rows, key=repr)
    for how, want in (("left_semi", True), ("left_anti", False)):
        got = iv.overlapping(a, b, how)
        assert got.columns == a.columns
        assert order((r.rec, r.start, r.end_excl) for r in got.collect()) == order(x for x in A if any(touch(x, y) for y in right) == want)


def test_met_gives_each_pair_once(spark):
    disjoint = [(0, 0, 3), (0, 3, 8), (0, 10, 11), (1, 5, 9), (None, 0, 9)]
    a = spark.createDataFrame(disjoint, ROW).withColumn("name", F.col("start") * 10)
    for right in (B, []):
        got = iv.met(a, spark.createDataFrame(right, ROW))
        assert got.columns == [*a.columns, "other"]
        pairs = sorted((r.rec, r.start, r.name, *r.other) for r in got.collect())
        assert pairs == sorted((x[0], x[1], 10 * x[1], *y) for x in disjoint for y in right if touch(x, y))


def test_held_points(spark):
    spans = [(0, 0, 1), (0, 1020, 1030), (0, 4000, 9000), (1, 3, 3), (1, 5, 8)]
    points = [(r, i) for r in (0, 1, None) for i in (0, 1, 3, 5, 7, 8, 1019, 1020, 1024, 1029, 1030, 4000, 8191, 8999, 9000, None)]
    got = iv.held(spark.createDataFrame(points, "rec long, idx long"), spark.createDataFrame(spans, ROW))
    want = [(r, i, s, e) for r, i in points for k, s, e in spans if None not in (r, i) and r == k and s <= i < e]
    assert sorted((x.rec, x.idx, x.start, x.end_excl) for x in got.collect()) == sorted(want)


def test_many_intervals_of_one_recording(spark):
    """Ten times the intervals may not take a hundred times as long; 100,000 in one recording take seconds."""

    def seconds(n):
        a = spark.range(n).select(F.lit(0).alias("rec"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end_excl"))
        b = a.select("rec", (F.col("start") + F.when(F.col("start") % 3 == 0, 3).otherwise(5)).alias("start"), (F.col("end_excl") + 5).alias("end_excl"))
        began = time.time()
        assert iv.overlapping(a, b, "left_semi").count() + iv.overlapping(a, b, "left_anti").count() == n
        assert maps.fuse(a, b.select("rec", F.lit("s1").alias("channel"), "start", "end_excl"), "number", 1).count() == -(-n // 3)
        maps.without_contaminated(a, b).count()
        iv.fill_gaps_over(a, b, 8).count()
        return time.time() - began

    seconds(100)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 20 and large < 30 * max(small, 0.5)


def test_bout_tables(spark):
    runs = spark.createDataFrame([(0, 0, 1), (0, 5, 65), (0, 68, 128), (0, 300, 360), (1, 0, 120)], ROW)
    each = {r.rec: tuple(r)[1:] for r in report.bouts(runs, 6).collect()}
    assert each == {0: (2, 60 + 63 + 60, 60, 60), 1: (1, 120, 120, 120)}
    assert tuple(report.bout_table(report.bouts(runs, 6), 2.0).first()) == (3, 303, 120, 60, 1.5, 101.0)
    assert tuple(report.bout_table(report.bouts(runs.where("false"), 6), 2.0).first()) == (None,) * 6
    # one sample a second: minutes in bouts, a gap of at most 6 s inside one
    got = {r.map: tuple(r)[1:] for r in hiccup.bouts_by_modality(runs.withColumn("map", F.when(F.col("rec") == 0, "piezo").otherwise("aclm")), 1.0, 6, hours=2.0).collect()}
    assert got["aclm"] == (1, 2.0, 2.0, 2.0, 2.0, 0.5)
    assert got["piezo"] == pytest.approx((2, 183 / 60, 123 / 60, 1.0, 183 / 120, 1.0))


def test_first_longest_and_regions(spark):
    runs = spark.createDataFrame([(0, 4, 5), (0, 8, 12), (0, 20, 22), (1, 1, 2)], ROW)
    take = lambda df: sorted(tuple(r) for r in df.collect())
    assert take(iv.first_run(runs)) == [(0, 4, 4), (1, 1, 1)]
    assert take(iv.longer(runs, 2)) == [(0, 8, 12, 4)]
    assert take(iv.regions(runs)) == [(0, 1, 8, 11), (0, 2, 20, 21)]


def test_peak_levels(spark):
    tall = spark.createDataFrame([(0, i, "a", float(-i)) for i in range(20)] + [(0, 3, "b", 2.0)], "rec long, idx long, channel string, x double")
    windows = spark.createDataFrame([(0, 0, 5), (0, 10, 15)], ROW)
    assert sorted(tuple(r) for r in report.peak_levels(tall, windows, 0.5).collect()) == [("a", 9.0), ("b", 2.0)]
