"""The registered query judges peaks: a rhythm of uneven ones is no hiccup."""

from pulsegrid.plans.registry import QUERIES, load


def test_uneven_peaks_are_left_out(spark, tmp_path):
    load()
    rows, kinds = [], ("click", "view", "signup")
    for user, low in ((1, 90.0), (2, 80.0)):
        for i in range(70):
            beat = (i - 10) // 2 if 10 <= i <= 44 and i % 2 == 0 else None
            kind, value = ("click", 0.0) if beat is None else (kinds[beat % 3], low if beat // 3 % 2 else 90.0)
            rows.append((100 * user + i, i, user, kind, value))
    events = spark.createDataFrame(rows, "event_id long, second int, user_id long, event_type string, value double")
    events.selectExpr("event_id", "timestamp_seconds(second) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.rec, r.start, r.end_excl) for r in QUERIES["hiccup_map"](spark, str(tmp_path)).collect()] == [(1, 9, 44)]
