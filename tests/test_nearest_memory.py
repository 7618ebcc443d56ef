"""Nearest rows hold a bounded number of distances, however many rows are kept."""

import tracemalloc

import numpy as np

from pulsegrid.ml.ensemble import NearestRowsModel


def test_distances_held_do_not_grow_with_the_rows_kept():
    rng = np.random.default_rng(0)
    rows, asked = rng.standard_normal((30_000, 8)), rng.standard_normal((300, 8))
    model = NearestRowsModel(rows, (rows[:, 0] > 0).astype(float), 5)
    tracemalloc.start()
    got = model.score(asked)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    for i in range(0, 300, 50):
        near = np.argsort(((rows - asked[i]) ** 2).sum(1).round(9), kind="stable")[:5]
        assert got[i] == model.y[near].mean()
