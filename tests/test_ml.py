"""Folds, normalising, votes and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import config
from pulsegrid.ml import boosting, models, prepare, store


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(i % 3 == 0), *(float(v) for v in rng.normal(i % 3 == 0, 0.6, 3)), 1.0) for i in range(150)]
    return spark.createDataFrame(data, "id long, label int, f0 double, f1 double, f2 double, c double").repartition(2)


def test_folds(spark, rows):
    f = prepare.stratified_folds(rows, "label", "id", 4)
    sizes = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert sizes == {(1, 0): 12, (1, 1): 12, (1, 2): 12, (1, 3): 14, **{(0, k): 25 for k in range(4)}}
    assert prepare.stratified_folds(rows, "label", "id", 4, ratio=1.0).where("label = 0").count() == 50


def test_mean_range(spark, rows):
    bad = rows.withColumn("n", F.when(F.col("id") == 3, float("nan")).otherwise(1.0))
    fitted = prepare.fit_mean_range(bad, ["f0", "c", "n"])
    assert set(fitted) == {"f0", "c"} and fitted["c"] == (1.0, 1e-8)
    out = prepare.mean_range(bad, fitted).toPandas()
    assert out.f0.max() - out.f0.min() == pytest.approx(1) and abs(out.f0.mean()) < 1e-9 and list(out.columns) == ["f0", "c"]


def test_rankers_and_votes(spark, rows):
    noisy = rows.withColumn("z", F.rand(1))
    columns = ["f0", "f1", "f2", "z"]
    named = [(r, f) for r, rank in (("t", prepare.rank_by_trees), ("l", prepare.rank_by_lasso), ("e", prepare.rank_by_elimination)) for f in rank(noisy, columns, "label", 3)]
    votes = {r.feature for r in prepare.voted(spark.createDataFrame(named, "ranker string, feature string"), 2).collect()}
    assert votes >= {"f0", "f1", "f2"} - {"z"} and "z" not in votes


def test_models_learn_and_vote(spark, rows):
    table = models.fourier_features(prepare.assembled(models.class_weights(prepare.stratified_folds(rows, "label", "id", 2)), ["f0", "f1", "f2"]), 3, gamma=0.5).cache()
    assert table.where("label = 1").first().weight == 2.0
    parts = []
    for name in ("log-regression", "random-forest", "svm"):
        out = models.out_of_fold(table, models.registry(3)[name], range(2))
        assert out.count() == 150 and models.area_under_curve(out) > 0.85
        parts.append(out.select("id", "label", "fold", F.lit(name).alias("model"), "score"))
    voted = models.soft_vote(parts[0].union(parts[1]).union(parts[2]), ["id", "label", "fold"])
    s = models.scores(voted).toPandas()
    assert (s.f1 > 0.7).all() and models.passes_gate(s.f1.mean()) and not models.passes_gate(0.5)
    best = models.tune(table, models.registry(3)["log-regression"](), {"regParam": [0.001, 1e6]})
    assert len(best.avgMetrics) == 2 and min(best.avgMetrics) > 0.7


def test_adaboost_is_the_algorithm(spark):
    """Against the same rounds in numpy, with the stumps that Spark fits."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2)).round(2)
    y = (x[:, 0] ** 2 + x[:, 1] > 0.6).astype(int)
    df = prepare.assembled(spark.createDataFrame([(i, int(t), float(a), float(b), 1.0) for i, (t, (a, b)) in enumerate(zip(y, x, strict=True))], "id long, label int, a double, b double, weight double"), ["a", "b"])
    model = boosting.AdaBoost(rounds=4, depth=1).fit(df)
    w, vote = np.ones(120), np.zeros(120)
    assert len(model.trees) == 4
    for tree, alpha in zip(model.trees, model.alphas, strict=True):
        p = np.array([r.prediction for r in tree.transform(df).orderBy("id").collect()])
        error = w[p != y].sum() / w.sum()
        assert alpha == pytest.approx(0.5 * np.log((1 - error) / error), rel=1e-6)
        w *= np.exp(alpha * np.where(p != y, 1, -1))
        vote += alpha * (2 * p - 1)
    got = prepare.probability_of_one(model.transform(df)).orderBy("id").collect()
    assert np.allclose([r.score for r in got], 1 / (1 + np.exp(-2 * vote))) and all(r.prediction == (r.score >= 0.5) for r in got)
    assert np.mean([r.prediction == t for r, t in zip(got, y, strict=True)]) > 0.8


def test_stored_models_predict_the_same(spark, rows, tmp_path):
    fitted = prepare.fit_mean_range(rows, ["f0", "f1", "f2"])
    store.save_processor(spark, fitted, ["f2", "f0"], f"{tmp_path}/p")
    again, ranked = store.load_processor(spark, f"{tmp_path}/p")
    assert again == fitted and list(again) == list(fitted) and ranked == ["f2", "f0"]
    ready = prepare.assembled(store.processed(rows, ["id", "label"], again, ranked).withColumn("weight", F.lit(1.0)), ranked)
    fits = {"log": models.registry(2)["log-regression"]().fit(ready), "ada": boosting.AdaBoost(rounds=2).fit(ready)}
    store.save_models(fits, f"{tmp_path}/m")
    for name, model in fits.items():
        a, b = ([r.score for r in prepare.probability_of_one(m.transform(ready)).orderBy("id").collect()] for m in (model, store.load_model(spark, f"{tmp_path}/m/{name}")))
        assert a == b
    folds = prepare.stratified_folds(ready, "label", "id", 2)
    assert models.best_fold(folds, models.registry(2)["log-regression"], range(2))[0] in (0, 1)


def test_stored_parameters(tmp_path):
    stages = {s: config.build(s, {"sensor_freq": 512}) for s in config.STAGES}
    (tmp_path / "c.yaml").write_text(store.config_text(stages))
    back = config.read(f"{tmp_path}/c.yaml")
    assert store.config_text(back) == store.config_text(stages) and back["segment"].sensor_freq == 512
