"""The hiccup detector on a rhythmic recording, an irregular one and an empty one."""

import random

from pulsegrid.operators import filters, hiccup
from pulsegrid.operators import intervals as iv

P = hiccup.HiccupParameters(fs=1.0, period=3, body_gap=2, continuous=20, exceptions_per_minute=20, tolerance=3, peak_distance=2, bout_gap=4, fusion="any_type", std_share=0.3)


def test_rhythmic_regions_are_found(spark):
    n = 120
    rhythm = range(30, 81, 5)
    rows, runs = [], []
    for rec in (0, 1, 2):
        for i in range(n):
            beat = rec < 2 and i in rhythm
            # recording 1 beats as long, but every other peak is higher
            height = (10.0 if rec == 0 or i % 2 else 14.0) if beat else 0.0
            rows.append((rec, i, height, 0.0))
            if beat:
                runs.append((rec, i - 1, i + 2))
    samples = spark.createDataFrame(rows, "rec long, idx long, s3 double, s1 double")
    reduced = spark.createDataFrame(runs, "rec long, start long, end_excl long")
    lengths = spark.createDataFrame([(r, n) for r in (0, 1, 2)], "rec long, n long")
    movement = reduced.where("false")
    regions = hiccup.candidate_regions(iv.merge(reduced), movement, lengths, P)
    assert sorted((r.rec, r.region, r.start, r.end_excl) for r in regions.collect()) == [(0, 1, 28, 82), (1, 1, 28, 82)]
    kept = hiccup.consistent(regions, samples, "s3", P, width=5)
    assert [(r.rec, r.start, r.end_excl) for r in kept.collect()] == [(0, 28, 82)]
    found = hiccup.detect_hiccups(iv.merge(reduced), movement, samples.select("rec", "idx", "s3"), lengths, P, width=5)
    assert {(r.rec, r.start, r.end_excl) for r in found.collect()} == {(r.rec, r.start, r.end_excl) for r in kept.collect()}
    assert iv.merge(reduced).where("rec = 2").count() == 0
    assert hiccup.candidate_regions(movement, movement, lengths, P).count() == 0


def test_peaks_of_many_regions_are_thinned_together(spark):
    rng = random.Random(4)
    rows = [(None if rec == 3 else rec, region, idx, float(rng.randrange(6))) for rec in range(20) for region in (1, 2) for idx in rng.sample(range(60), rng.randrange(1, 25))]
    peaks = spark.createDataFrame(rows, "rec long, region long, idx long, x double")
    want = set()
    for key in {r[:2] for r in rows}:
        mine = sorted(r for r in rows if r[:2] == key)
        want |= {mine[i] for i in filters.keep_distant([r[2] for r in mine], [r[3] for r in mine], 4)}
    for most in (1, 50, 100_000):
        thinned = filters.distant(peaks, 4, ("rec", "region"), most)
        got = [tuple(r) for r in thinned.collect()]
        assert len(got) == len(want) and set(got) == want
    regions = spark.createDataFrame([(0, 1, 0, 50)], "rec long, region long, start long, end_excl long")
    plan = hiccup.consistent(regions, peaks.withColumnRenamed("x", "s3"), "s3", P, 5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan  # no call of Python for every region
