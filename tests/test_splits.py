"""Files read by ranges give the rows and counts of one walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import recordings, splits


def messy(path, seed, packets=60):
    """Garbage before packets, some of it signatures, and payloads that hold signatures."""
    rng = random.Random(seed)
    garbage = {i: bytes(rng.choice([0x4B, 0x50, 0, 7]) for _ in range(rng.randrange(1, 400))) for i in rng.sample(range(packets), 12)}
    recordings.write_v2(str(path), packets, sync=seed % 2 == 0, garbage=garbage, cut=rng.choice([0, 3, 100, 250]))
    data = bytearray(path.read_bytes())
    for _ in range(80):
        at = rng.randrange(200, len(data) - 2)
        data[at : at + 2] = b"KP"
    path.write_bytes(bytes(data))


@pytest.mark.parametrize("split", [1, 700, 5_000, 1 << 20])
def test_any_split_is_one_walk(spark, tmp_path, split):
    for seed in range(4):
        messy(tmp_path / f"{seed}.dat", seed)
    recordings.write_v2(str(tmp_path / "none.dat"), 0)
    recordings.write_v2(str(tmp_path / "one.dat"), 1, cut=4)
    recordings.write_v1(str(tmp_path / "other.dat"), [{"force": [1]}])
    (tmp_path / "empty.dat").write_bytes(b"")
    want = recordings.read_recordings(spark, str(tmp_path)).where("error is null and file_format = 'v2'")
    columns = ["rec", "packets_found", "corrupted_skipped", "bytes_read", "n_samples"]
    counts = {tuple(r) for r in splits.v2_counts(spark, str(tmp_path), split).select(*columns).collect()}
    assert counts == {tuple(r) for r in want.select(*columns).collect()} and len(counts) == 6
    names = want.select("rec")
    rows = recordings.read_samples(spark, str(tmp_path)).join(F.broadcast(names), "rec", "left_semi")
    key = lambda r: (r.rec, r.idx)
    assert sorted(map(tuple, splits.v2_samples(spark, str(tmp_path), split).collect())) == sorted(map(tuple, rows.collect()))


def test_walks_from_every_entry():
    rng = random.Random(3)
    data = bytes(rng.choice([0x4B, 0x50, 1]) for _ in range(2000)) + b"KP" + bytes(600)
    mark = b"KP"
    for stop, last in ((1500, False), (len(data), True), (1990, False)):
        leaves, packets, skipped = splits.walks(data[: stop + 1] if not last else data, stop, last)
        for entry in range(0, splits.SIZE, 7):
            pos, n, gone = entry, 0, 0
            while (pos + 8 <= stop) if last else (pos < stop):
                if data[pos : pos + 2] == mark:
                    if last and pos + splits.SIZE > stop:
                        break
                    pos, n = pos + splits.SIZE, n + 1
                else:
                    pos, gone = pos + 1, gone + 1
            assert (leaves[entry], packets[entry], skipped[entry]) == (pos, n, gone), (stop, entry)


def test_nothing_to_walk():
    assert [np.unique(v).tolist() for v in splits.walks(b"", 0, True)][1:] == [[0], [0]]
