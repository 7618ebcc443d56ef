"""Nearest rows beyond what is broadcast: all rows count, and the answers are those of the broadcast ones."""

import numpy as np
import pytest

from pulsegrid.ml import ensemble, models, prepare, store


def rows(spark, x, y):
    columns = [f"f{i}" for i in range(x.shape[1])]
    values = [(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return prepare.assembled(spark.createDataFrame(values, "id long, label int, " + ", ".join(f"{c} double" for c in columns)).repartition(3), columns)


def test_no_row_is_left_out(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 3)), 1)  # with equal rows and equally near ones
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = rows(spark, x, y)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    sent = ensemble.NearestRows(k=5).fit(train)
    want = {r.id: r.probability[1] for r in sent.transform(test).collect()}
    monkeypatch.setattr(ensemble, "MOST_SENT", 100)
    monkeypatch.setattr(ensemble, "ROW_BLOCK", 170 * 24)
    monkeypatch.setattr(ensemble, "ASKED_BLOCK", 70 * 24)
    table = models.registry(3)["nearest-rows"]().fit(train)
    assert isinstance(table, ensemble.NearestRowsTable) and table.rows.count() == 600
    got = table.transform(test)
    assert set(got.columns) == {*df.columns, "probability", "prediction"}
    assert {r.id: r.probability[1] for r in got.collect()} == pytest.approx(want)
    store.save_models({"near": table}, str(tmp_path))
    again = store.load_model(spark, f"{tmp_path}/near")
    assert isinstance(again, ensemble.NearestRowsTable)
    assert {r.id: r.probability[1] for r in again.transform(test).collect()} == pytest.approx(want)
    assert table.transform(test.where("id < 0")).count() == 0


def test_more_than_fifty_thousand_rows_are_all_kept(spark):
    df = prepare.assembled(spark.range(50_001).selectExpr("id", "cast(id = 50000 as int) as label", "cast(id as double) as f0"), ["f0"])
    model = ensemble.NearestRows(k=1).fit(df)
    assert {r.id: r.prediction for r in model.transform(df.where("id >= 49990")).collect()} == {i: float(i == 50_000) for i in range(49_990, 50_001)}


@pytest.mark.parametrize("n", [1, 4, 37, 5000])
def test_bounds_hide_no_row(n):
    rng = np.random.default_rng(n)
    x, asked = np.round(rng.normal(size=(n, 2)), 1), np.round(rng.normal(size=(50, 2)), 1)
    k = min(5, n)
    for i, (places, far) in enumerate(ensemble.nearest_places(asked, x, k, cells=9000)):
        apart = ((x**2).sum(1) - 2 * asked[i] @ x.T + (asked[i] ** 2).sum()).round(9)
        assert np.array_equal(np.sort(far), np.sort(apart)[:k]) and len(set(places)) == k
        assert np.allclose(((x[places] - asked[i]) ** 2).sum(1), far)
