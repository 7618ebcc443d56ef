"""The learners that Spark ML does not have, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.ml import boosting, ensemble, extra_trees, models, neighbours, prepare, store


def frame(spark, x, y, w=None):
    w = np.ones(len(x)) if w is None else w
    columns = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, int(t), float(v), *map(float, r)) for i, (r, t, v) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame(rows, "id long, label int, weight double, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    return prepare.assembled(df, columns), columns


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[:, 5] = np.round(x[:, 5])  # a column with ties
    return x, ((x[:, 0] + x[:, 1] ** 2 + 0.3 * x[:, 5]) > 0.8).astype(int)


# neighbourhood components


def plain_objective(a, x, y):
    """Row by row, and the gradient by outer products of differences."""
    value, gradient = 0.0, np.zeros_like(a)
    for i in range(len(x)):
        d = x[i] - x
        k = np.exp(-((d @ a.T) ** 2).sum(1))
        k[i] = 0
        p = k / k.sum()
        right = p[y == y[i]].sum()
        value += right
        weights = p * right - p * (y == y[i])
        gradient += 2 * a @ (d.T @ (weights[:, None] * d))
    return value, gradient


def test_blocks_add_up_to_the_plain_gradient(data):
    x, y = data[0][:90], data[1][:90]
    a = np.random.default_rng(1).normal(size=(3, 6)) / 2
    parts = [neighbours.block_part(a, x, y, i, min(i + 40, 90)) for i in range(0, 90, 40)]
    value, gradient = plain_objective(a, x, y)
    assert sum(p[0] for p in parts) == pytest.approx(value)
    assert np.allclose(sum(p[1] for p in parts), gradient)
    step = 1e-6 * np.eye(1, 18, 7).reshape(3, 6)
    assert (plain_objective(a + step, x, y)[0] - plain_objective(a - step, x, y)[0]) / 2e-6 == pytest.approx(gradient.ravel()[7], rel=1e-4)


def test_column_order_is_that_of_the_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)) * [1, 1, 3, 0.5, 1]
    y = ((x[:, 0] - x[:, 3] * 2) > 0).astype(int)
    df, columns = frame(spark, x, y)
    monkeypatch.setattr(neighbours, "BLOCK", 130)
    got = neighbours.neighbour_components(df, columns, "label", components=2, rounds=6)
    centred = x - x.mean(0)
    want = neighbours.climbed(lambda a: plain_objective(a, centred, y), neighbours.principal_axes(centred, 2), 6)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-7)
    assert np.array_equal(np.argsort(-np.abs(got[0])), np.argsort(-np.abs(want[0])))
    assert plain_objective(got, centred, y)[0] > plain_objective(neighbours.principal_axes(centred, 2), centred, y)[0]
    assert neighbours.rank_by_neighbours(df, columns, "label", 3, components=2, rounds=6) == [columns[i] for i in np.argsort(-np.abs(want[0]))[:3]]


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double, label int")
    assert neighbours.neighbour_components(empty, ["a", "b"], "label", components=1).tolist() == [[1, 0]]
    holes = spark.createDataFrame([(1.0, None, 1), (None, 2.0, 0), (1.0, float("nan"), 0), (1.0, 1.0, None)], "a double, b double, label int")
    assert neighbours.rank_by_neighbours(holes, ["a", "b"], "label", 2) == ["a", "b"]


# extra-trees


def plain_tree(x, y, w, tree, most, depth, seed):
    """Node by node, recursively."""
    out = {}

    def grow(n, rows):
        total = np.array([w[rows][y[rows] == c].sum() for c in (0, 1)])
        out[n] = (-1, 0.0, total[1] / total.sum())
        if n >= 1 << depth or total.min() <= 0:
            return
        which, share = extra_trees.drawn(seed, tree, n, x.shape[1], most)
        best = (1e-9, None)
        for j, u in zip(which, share, strict=True):
            low, high = x[rows, j].min(), x[rows, j].max()
            cut = low + u * (high - low)
            left = rows[x[rows, j] <= cut]
            if high > low:
                a = np.array([w[left][y[left] == c].sum() for c in (0, 1)])
                gain = float(extra_trees.gini(total) - extra_trees.gini(a) - extra_trees.gini(total - a))
                if gain > best[0]:
                    best = (gain, (j, cut))
        if best[1]:
            j, cut = best[1]
            out[n] = (j, cut, out[n][2])
            grow(2 * n, rows[x[rows, j] <= cut])
            grow(2 * n + 1, rows[x[rows, j] > cut])

    grow(1, np.arange(len(x)))
    return out


@pytest.mark.parametrize("columns", [None, 6])
def test_trees_equal_the_plain_version(spark, data, columns):
    x, y = data
    w = np.where(y == 1, 2.0, 1.0)
    df, _ = frame(spark, x, y, w)
    model = extra_trees.ExtraTrees(trees=3, depth=4, columns=columns, seed=9).fit(df)
    for t in range(3):
        want = plain_tree(x, y, w, t, columns or 2, 4, 9)
        f = model.forest
        assert {n for n in range(1, 32) if n in want and want[n][0] >= 0} == set(np.flatnonzero(f.feature[t] >= 0))
        for n, (j, cut, one) in want.items():
            assert f.feature[t, n] == j and f.cut[t, n] == pytest.approx(cut, abs=1e-12) and f.one[t, n] == pytest.approx(one)


def test_extra_trees_learn_rank_and_are_stored(spark, data, tmp_path):
    x, y = data
    df, columns = frame(spark, x, y)
    model = extra_trees.ExtraTrees(trees=20, depth=6).fit(df)
    got = model.transform(df).orderBy("id").collect()
    assert np.mean([r.prediction == r.label for r in got]) > 0.85 and model.importances.sum() == pytest.approx(1)
    assert set(np.argsort(-model.importances)[:2]) == {0, 1}
    assert set(prepare.rank_by_elimination(df.select(*columns, "label"), columns, "label", 2, step=2, extra=True)) == {"f0", "f1"}
    store.save_models({"forest": model}, str(tmp_path))
    again = store.load_model(spark, f"{tmp_path}/forest").transform(df).orderBy("id").collect()
    assert [r.probability for r in again] == [r.probability for r in got]


def test_forests_of_little(spark):
    one, _ = frame(spark, np.ones((5, 2)), np.ones(5))
    assert {r.prediction for r in extra_trees.ExtraTrees(trees=2).fit(one).transform(one).collect()} == {1.0}
    same, _ = frame(spark, np.ones((4, 2)), np.array([0, 0, 0, 1]))
    assert {r.probability[1] for r in extra_trees.ExtraTrees(trees=2).fit(same).transform(same).collect()} == {0.25}
    none = one.where("id < 0")
    assert {r.prediction for r in extra_trees.ExtraTrees(trees=2).fit(none).transform(one).collect()} == {0.0}


# boosting by probabilities


@pytest.mark.parametrize("stumps", [0, 3])
def test_real_boost_is_the_algorithm(spark, data, stumps):
    """Against the same rounds in numpy, with the bases that Spark fits."""
    x, y = data
    df, _ = frame(spark, x, y)
    model = boosting.RealBoost(rounds=3, depth=2, stumps=stumps).fit(df)
    assert len(model.models) == 3
    w, odds = np.ones(len(x)), []
    for i, base in enumerate(model.models):
        weighted = df.join(spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "id long, _w double"), "id")
        p = np.array([r.probability[1] for r in base.transform(df).orderBy("id").collect()])
        again = np.array([r.probability[1] for r in boosting.RealBoost(depth=2, stumps=stumps).base(i).fit(weighted).transform(df).orderBy("id").collect()])
        assert np.allclose(p, again, atol=1e-6)
        p = p.clip(boosting.LEAST, 1 - boosting.LEAST)
        odds.append(np.log(p) - np.log(1 - p))
        w = w * np.exp(-0.5 * (2 * y - 1) * odds[-1])
        w *= len(w) / w.sum()
    got = model.transform(df).orderBy("id").collect()
    assert np.allclose([r.probability[1] for r in got], 1 / (1 + np.exp(-np.mean(odds, axis=0))), atol=1e-9)
    assert np.mean([r.prediction == r.label for r in got]) > 0.8 and set(got[0].asDict()) == {*df.columns, "probability", "prediction"}


# nearest rows and the ensemble


def test_nearest_rows_and_ensemble(spark, data, tmp_path):
    x, y = data
    df, _ = frame(spark, x, y)
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    members = {"log": models.registry(6)["log-regression"], "near": lambda: ensemble.NearestRows(k=3), "boost": lambda: boosting.RealBoost(rounds=2)}
    model = ensemble.Ensemble(members).fit(train)
    got = model.transform(test).orderBy("id").collect()
    a, b = np.arange(300) % 3 != 0, np.arange(300) % 3 == 0
    apart = ((x[b][:, None] - x[a][None]) ** 2).sum(-1)
    near = y[a][np.argsort(apart, axis=1)[:, :3]].mean(1)
    assert np.allclose([r.score_near for r in got], near)
    assert np.allclose([r.probability[1] for r in got], [(r.score_log + r.score_near + r.score_boost) / 3 for r in got])
    assert set(got[0].asDict()) == {*df.columns, "score_log", "score_near", "score_boost", "probability", "prediction"}
    store.save_models(model.members, str(tmp_path))
    again = ensemble.EnsembleModel({n: store.load_model(spark, f"{tmp_path}/{n}") for n in members}).transform(test).orderBy("id").collect()
    assert [r.probability for r in again] == [r.probability for r in got]
    nobody = ensemble.NearestRows().fit(train.where("id < 0"))
    assert {r.prediction for r in nobody.transform(test).collect()} == {0.0}
    assert ensemble.NearestRows(most_rows=7).fit(train.withColumn("label", F.col("label"))).x.shape == (7, 6)
