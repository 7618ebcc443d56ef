"""The stages of corpus_pipeline.py on planted documents and on edge cases."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed, lines=6):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(15)) + "." for _ in range(lines))


def test_pipeline_on_planted_documents(spark, tmp_path):
    item = " ".join(text_of(999, 2).split())
    clean = [text_of(i) for i in range(8)]
    near = clean[0].replace(clean[0].split()[40], "changed", 1)
    rows = [*clean, clean[1], near, text_of(50) + "\n" + item, text_of(60) + "\ncard 4111 1111 1111 1111 here today friends.", "too short", None, "", "$$$ ### " * 100]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(rows)], SCHEMA)
    folder = str(tmp_path)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        kept.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
        if name != "tokens":
            assert at.columns == list(corpus_pipeline.COLUMNS)
    assert kept[0] == list(range(12))
    assert kept[1] == [0, 1, 2, 3, 4, 5, 6, 7, 10, 11]
    assert kept[2] == kept[3] == kept[4] == [0, 1, 2, 3, 4, 5, 6, 7, 11]
    out = {r.doc_id: r for r in at.collect()}
    assert out[0].decoded == clean[0] and out[0].n_tokens == len(np.frombuffer(out[0].ids, "<u4"))
    assert "4111 1111 1111 1111" not in out[11].decoded and "friends." in out[11].decoded
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(out)


def test_pipeline_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
