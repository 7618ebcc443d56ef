"""From a manifest to a feature store: once each, with errors kept, and again. Nearest neighbours."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from pulsegrid import config
from pulsegrid.operators.nearest import nearest
from pulsegrid.plans import dataset
from pulsegrid.sources import recordings

FS = 64


def stages():
    own = {"sensor_freq": FS, "sensation_freq": FS}
    c = {s: config.build(s, dict(own)) for s in config.STAGES}
    c["segment"] = config.build("segment", own | {"fm_min_sn": 20, "fm_dilation": 1.0, "imu_modalities": ("imu_acceleration", "imu_rotation"), "imu_acceleration_threshold": 5.0, "imu_rotation_threshold": 50.0})
    return c


def write(path, bursts, seconds=40, seed=0):
    t = np.arange(FS * seconds) / FS
    wave = np.random.default_rng(seed).normal(0, 30, len(t)) + 12000 * np.sin(2 * np.pi * 8 * t) * sum(((t > b) & (t < b + 1.5)) for b in bursts)
    recordings.write_v1(str(path), [{"piezo": [int(32768 + w)] * 4, **({"imu": [10000, 0, 0, 0, 0, 0, 0, 0, 0, 9810]} if i % 8 == 0 else {})} for i, w in enumerate(wave)])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "a b").mkdir(parents=True)
    write(tmp_path / "in" / "a b" / "1.dat", (12, 25))
    write(tmp_path / "in" / "2.dat", (20,), seed=1)
    (tmp_path / "in" / "bad.dat").write_bytes(b"KAHAnothing")
    return tmp_path


def manifest(spark, *keys):
    return spark.createDataFrame([(None, k, None) for k in keys], "bucket string, dat_file_key string, csv_file_key string")


def content(spark, store):
    return sorted((r.dat_file_key, r.start_indices, r.end_indices, r.labels, r.feature_set, r.sensor_3_max) for r in dataset.read_features(spark, store).collect())


def test_build_is_done_once(spark, folder, monkeypatch):
    root, store = f"{folder}/in/", f"{folder}/store"
    keys = ("a b/1.dat", "a b/1.dat", "bad.dat", "gone.dat", None)
    got = {r.dat_file_key: r for r in dataset.build(spark, manifest(spark, *keys), root, store, stages()).collect()}
    assert set(got) == {"a b/1.dat", "bad.dat", "gone.dat"}
    assert got["a b/1.dat"].error is None and got["a b/1.dat"].n_detections == 2
    assert got["bad.dat"].error and got["bad.dat"].n_detections is None and got["gone.dat"].error == "no such file"
    first = content(spark, store)
    assert len(first) == 2
    # only what is missing is read again; failures stay one row each
    seen, whole = [], dataset._extract
    monkeypatch.setattr(dataset, "_extract", lambda s, items, *rest: seen.append(sorted(k for k, _ in items)) or whole(s, items, *rest))
    again = dataset.build(spark, manifest(spark, *keys, "2.dat"), root, store, stages())
    assert seen == [["2.dat", "bad.dat"]] and again.count() == 4
    second = content(spark, store)
    assert [r for r in second if r[0] == "a b/1.dat"] == first and len(second) == 3
    # a forced run writes the same
    dataset.build(spark, manifest(spark, *keys, "2.dat"), root, store, stages(), force=True)
    assert content(spark, store) == second


def test_one_failing_file_costs_no_other(spark, folder, monkeypatch):
    whole = dataset._extract

    def fails(s, items, *rest):
        if any(k == "bad.dat" for k, _ in items):
            raise PythonException("Traceback\nValueError: cannot")
        return whole(s, items, *rest)

    monkeypatch.setattr(dataset, "_extract", fails)
    got = {r.dat_file_key: (r.error, r.n_detections) for r in dataset.build(spark, manifest(spark, "bad.dat", "2.dat"), f"{folder}/in", f"{folder}/s", stages()).collect()}
    assert got == {"bad.dat": ("ValueError: cannot", None), "2.dat": (None, 1)}


def test_no_features(spark, folder):
    with pytest.raises(ValueError, match="no features"):
        dataset.read_features(spark, f"{folder}/nothing")
    dataset.build(spark, manifest(spark, "bad.dat"), f"{folder}/in", f"{folder}/s", stages())
    with pytest.raises(ValueError, match="no features"):
        dataset.read_features(spark, f"{folder}/s")


@pytest.mark.parametrize("block, at_once", [(8192, 16384), (3, 7)])
def test_nearest_with_ties_and_nulls(spark, block, at_once):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 3)).astype(float) + 1000  # many repeated rows, far from the origin
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([*rows, (None, [0.0] * 3), (99, None)], "id long, v array<double>")
    asked = table.where("id % 5 = 0 or id is null or id = 99")
    got = sorted((r.id, r.k, r.near, r.dist) for r in nearest(asked, table, "id", "v", 4, block, at_once).collect())
    want = []
    for i, v in rows[::5]:
        best = sorted((round(float(np.sqrt(((x[j] - v) ** 2).sum())), 6), j) for j, _ in rows if j != i)[:4]
        want += [(i, n + 1, j, d) for n, (d, j) in enumerate(best)]
    assert got == sorted(want)
    few = table.where("id < 3")
    assert nearest(few, few, "id", "v", 4, block, at_once).count() == 6 and nearest(few, few.where("false"), "id", "v", 4).count() == 0
