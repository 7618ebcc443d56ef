"""Readers on synthetic files, and the whole way from a file to features."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import config
from pulsegrid.operators import report
from pulsegrid.plans import detection, service
from pulsegrid.sources import recordings, tables


def test_v2_files(spark, tmp_path):
    recordings.write_v2(f"{tmp_path}/clean.dat", 5)
    recordings.write_v2(f"{tmp_path}/dirty.dat", 5, sync=True, garbage={0: b"PKx", 2: b"\1\2\3\4\5"}, cut=10)
    recordings.write_v2(f"{tmp_path}/none.dat", 0)
    bad = bytearray((tmp_path / "clean.dat").read_bytes())
    bad[44:48] = b"oops"
    (tmp_path / "bad.dat").write_bytes(bytes(bad))
    (tmp_path / "tiny.dat").write_bytes(b"ab")
    got = {r.rec.rsplit("/", 1)[1]: r for r in recordings.read_recordings(spark, str(tmp_path)).collect()}
    assert got["clean.dat"].packets_found == 5 and got["clean.dat"].n_samples == 320 and got["clean.dat"].device_id == "TEST"
    assert got["clean.dat"].start_ms == 1_700_000_000_500 and got["clean.dat"].mac == "000102030405" and got["clean.dat"].freq_piezo == 1024
    assert got["none.dat"].n_samples == 0 and got["none.dat"].error is None
    assert "signature" in got["bad.dat"].error and got["tiny.dat"].file_format == "unknown" and got["tiny.dat"].error
    s = recordings.read_samples(spark, str(tmp_path))
    clean = s.where(F.col("rec").endswith("clean.dat")).orderBy("idx").collect()
    n = np.arange(320)
    assert [r.piezo[0] for r in clean] == (32768 + 20000 * np.sin(2 * np.pi * n / 1024)).astype(int).tolist()
    assert [r.idx for r in clean if r.imu] == list(range(0, 320, 8)) and clean[8].imu == [10000, 0, 0, 0, 50, 60, 70, 0, 0, 9810]


def test_v2_resynchronises_like_a_byte_walk(tmp_path):
    path = str(tmp_path / "x.dat")
    recordings.write_v2(path, 6, garbage={0: b"\0" * 3, 3: b"P" * 9, 5: b"K"}, cut=300)
    data = open(path, "rb").read()
    header, _ = recordings.parse_v2(data)
    pos, found, skipped = 48, 0, 0
    while pos < len(data) and pos + 8 <= len(data):
        if data[pos : pos + 2] == b"KP":
            if pos + 424 > len(data):
                break
            found, pos = found + 1, pos + 424
        else:
            skipped, pos = skipped + 1, pos + 1
    assert (header["packets_found"], header["corrupted_skipped"], header["bytes_read"]) == (found, skipped, pos)
    assert recordings.parse_v2(data, max_packets=2)[0]["packets_found"] == 2


def test_v1_files(spark, tmp_path):
    rows = [{"piezo": [65535, 0, 1, 2], "accel": [1, 2, 3, 4, 5, 6], "imu": [-5, 10, 20, 30, 1, 2, 3, -1000, 0, 9000], "force": [7], "time": [1, 2, 3], "press": True}, {}, {"press": True}, *({"piezo": [i, i, i, i], **({"imu": list(range(10))} if i % 8 == 0 else {})} for i in range(20))]
    path = f"{tmp_path}/one.dat"
    recordings.write_v1(path, rows)
    with open(path, "ab") as f:
        f.write(b"\x80\1\2")  # a record cut off
    s = recordings.read_samples(spark, path).orderBy("idx").collect()
    assert len(s) == len(rows) and s[0].piezo == [65535, 0, 1, 2] and s[0].imu[7] == -1000 and s[0].force == 7
    assert [r.press for r in s[:4]] == [1, 0, 1, 0] and s[1].piezo is None and s[3].imu == list(range(10)) and s[4].imu is None
    r = recordings.read_recordings(spark, path).first()
    assert (r.file_format, r.start_ms, r.end_ms, r.n_samples) == ("v1", 1_600_000_000_250, 1_600_000_010_750, len(rows))


def test_manifest_and_stores(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "items": [{"bucketName": "b", "datFileKey": "a/x.dat"}, {"datFileKey": "y.dat", "csvFileKey": "z.csv"}]}))
    m = tables.read_manifest(spark, f"{tmp_path}/m.json")
    assert [(r.bucket, r.dat_file_key, r.csv_file_key) for r in m.orderBy("dat_file_key").collect()] == [("b", "a/x.dat", "a/x.csv"), (None, "y.dat", "z.csv")]
    f = spark.createDataFrame([("y.dat", 0, 5, 1, "crafted", 0.5)], "dat_file_key string, start_indices long, end_indices long, labels int, feature_set string, x double")
    tables.append_features(f, f"{tmp_path}/store")
    assert [r.dat_file_key for r in tables.missing(m, spark.read.parquet(f"{tmp_path}/store")).collect()] == ["a/x.dat"]
    (tmp_path / "l.txt").write_text("one\n\n two \n")
    assert [r.path for r in tables.read_file_list(spark, f"{tmp_path}/l.txt").collect()] == ["one", "two"]
    p = spark.createDataFrame([("y.dat", 1, 4, 1, 0.9), ("y.dat", 5, 99, 1, 0.9), ("y.dat", 2, 3, 0, 0.1)], "dat_file_key string, start_indices long, end_indices long, predictions int, prediction_scores double")
    tables.write_predictions(p, f"{tmp_path}/p")
    n = spark.createDataFrame([("y.dat", 50)], "rec string, n long")
    assert [(r.start, r.end_excl) for r in tables.valid_predictions(tables.read_predictions(spark, f"{tmp_path}/p"), n).collect()] == [(1, 4)]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data_pipeline:\n  base: &b\n    sensor_freq: 512\n  segment:\n    <<: *b\n    fm_min_sn: [1,2,3,4,5,6]\n")
    c = config.read(f"{tmp_path}/c.yaml", ["segment.imu_dilation=5.5", "fusion.desired_scheme=['number', 1]"])
    assert c["segment"].samples(c["segment"].imu_dilation) == 2816 and c["segment"].factor("sensor_6") == 6.0 and c["fusion"].desired_scheme == ["number", 1]
    assert c["preprocess"].debounce_samples == 100 and c["load"].sensors == ["sensor_3", "sensor_6"] and not c["load"].all_types
    assert config.Base(sensor_selection=("accelerometer_right", "other")).sensors == ["sensor_2", "sensor_4", "sensor_5"]
    for bad in ("segment.nothing=1",):
        with pytest.raises(ValueError, match="no parameter"):
            config.override(c, [bad])
    with pytest.raises(ValueError, match="no parameter"):
        config.build("segment", {"strange": 1})


def test_from_file_to_answers(spark, tmp_path):
    """Bursts on the piezo channels of a quiet recording come out as detections, with features and an answer."""
    rng = np.random.default_rng(0)
    fs, seconds = 64, 60
    n = fs * seconds
    t = np.arange(n) / fs
    wave = rng.normal(0, 30, n) + 12000 * np.sin(2 * np.pi * 8 * t) * (((t > 20) & (t < 22)) | ((t > 40) & (t < 41)))
    presses = {int(20.9 * fs), int(21.0 * fs)}
    rows = [{"piezo": [int(32768 + wave[i])] * 4, "press": i in presses, **({"imu": [10000, 0, 0, 0, 0, 0, 0, 0, 0, 9810]} if i % 8 == 0 else {})} for i in range(n)]
    path = f"{tmp_path}/r.dat"
    recordings.write_v1(path, rows)
    own = {"sensor_freq": fs, "sensation_freq": fs}
    c = {s: config.build(s, dict(own)) for s in config.STAGES}
    c["preprocess"] = config.build("preprocess", own | {"debounce_thresh": 200.0})
    c["segment"] = config.build("segment", own | {"fm_min_sn": 20, "fm_dilation": 1.0, "imu_modalities": ("imu_acceleration", "imu_rotation"), "imu_acceleration_threshold": 5.0, "imu_rotation_threshold": 50.0})
    c["extract_feat"] = config.build("extract_feat", own)
    out = detection.detect(recordings.read_samples(spark, path), c)
    dets = sorted((r.start / fs + 5, r.end_excl / fs + 5, r.label) for r in out["detections"].collect())
    assert len(dets) == 2 and abs(dets[0][0] - 19.5) < 1 and abs(dets[0][1] - 22.5) < 1 and [d[2] for d in dets] == [1, 0]
    features = out["features"].orderBy("start").toPandas()
    assert len(features) == 2 and len(features.columns) == 4 + 4 * 53 + 1 and len(set(features.columns)) == len(features.columns)
    assert features["sensor_3_freq_mode"].between(7, 17).all()
    requests = spark.createDataFrame([("j1", "now", recordings.files(spark, path).first().rec, False, False, True), ("j2", "now", "missing", False, False, True)], service.REQUEST)
    starts = recordings.read_recordings(spark, path).select("rec", "start_ms")
    got = {r.jobId: r for r in service.answers(requests, service.movement_of(out["detections"], out["runs"], out["movement"], out["samples"], out["lengths"]), out["lengths"], starts, fs, 1.0, "m").collect()}
    body = json.loads(got["j1"].body)
    assert got["j1"].status == "Completed" and body["result"]["numKicks"] == 2 and len(body["result"]["events"]) == 2 and got["j2"].status == "Failed"


def test_answers_by_request(spark):
    """Every flag of a request, all types of events, matches only where something was pressed."""
    rows = lambda *r: spark.createDataFrame(r, "rec string, start long, end_excl long")
    ml, hiccups = rows(("a", 100, 200), ("a", 400, 500), ("a", 1000, 1100), ("b", 10, 20)), rows(("a", 390, 600))
    lengths = spark.createDataFrame([("a", 6400), ("b", 6400)], "rec string, n long")
    others = None
    for i, name in enumerate(service.OTHERS):
        part = rows(("a", 2000 + i, 2100)).withColumn("map", F.lit(name))
        others = part if others is None else others.unionByName(part)
    counts = spark.createDataFrame([("a", 1, 2, 3, 4), ("b", 5, 6, 7, 8)], "rec string, tp long, fp long, tn long, fn long")
    matches = report.match_presses(counts, rows(("a", 5, 6)), ml)
    assert {r.rec: (r.tp, r.fp, r.tn, r.fn, r.num_pressed, r.num_detections) for r in matches.collect()} == {"a": (1, 2, 3, 4, 1, 3), "b": (0, 0, 0, 0, 0, 1)}
    flags = [("1", "t", "a", False, False, True), ("2", "t", "a", True, True, True), ("3", "t", "b", None, None, False), ("4", "t", "c", True, True, True)]
    starts = spark.createDataFrame([("a", 0), ("b", 0)], "rec string, start_ms long")
    asked = spark.createDataFrame(flags, service.REQUEST)
    got = {r.jobId: json.loads(r.body) for r in service.answers(asked, ml, lengths, starts, 64.0, 1.0, "m", hiccups, others, matches).collect()}
    plain, cleaned, quiet = (got[i]["result"] for i in "123")
    assert plain["numKicks"] == 3 and "post_hiccup" not in plain and "onsetInterval" not in plain
    assert {e["event_type"] for e in plain["events"]} == {service.KICKS, *service.OTHERS}
    assert cleaned["numKicks"] == 3 and cleaned["post_hiccup"]["numKicks"] == 2
    assert cleaned["onsetInterval"] == [300 / 64, 600 / 64] and cleaned["post_hiccup_onsetInterval"] == [900 / 64]
    assert {e["event_type"] for e in cleaned["events"]} == {service.KICKS, service.HICCUPS, *service.OTHERS}
    assert quiet["numKicks"] == 1 and "events" not in quiet and "match" not in quiet and plain["match"]["tp"] == 1
    assert got["4"]["status"] == "Failed"
    untimed = service.answers(asked, ml, lengths, starts.select("rec"), 64.0, 1.0, "m").where("jobId = '1'").first()
    assert "events" not in json.loads(untimed.body)["result"]
