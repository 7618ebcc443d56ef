"""Near-dedup gets its first links through SimHash fingerprints."""

from pulsegrid.llm import set_dedup


def test_fingerprints_are_linked_first(spark, monkeypatch):
    asked = []
    links = set_dedup.fingerprint_links

    def seen(nodes, distance):
        asked.append(distance)
        return links(nodes, distance)

    monkeypatch.setattr(set_dedup, "fingerprint_links", seen)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(f"v{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs, rounds=0).collect()}
    assert asked == [3] and got == {0: 0, 1: 0, 2: 2}


def test_rounds_that_settle_nothing_end(spark, monkeypatch):
    """Texts that share half of their words with another are in shared keys and never linked."""
    rounds, written = [], []
    pivots, write = set_dedup.by_pivots, set_dedup.Scratch._written
    monkeypatch.setattr(set_dedup, "by_pivots", lambda *args: rounds.append(1) or pivots(*args))
    monkeypatch.setattr(set_dedup.Scratch, "_written", lambda self, df, path: written.append(df.columns) or write(self, df, path))
    texts = []
    for i in range(20):
        same = [f"s{i}x{j}" for j in range(100)]
        texts += [" ".join([*same, *(f"{side}{i}x{j}" for j in range(100))]) for side in "ab"]
    copy = [f"w{j}" for j in range(200)]
    texts += [" ".join(copy), " ".join([*copy[:-9], "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in set_dedup.near_copies(docs).collect()}
    assert got == {i: min(i, 40) for i in range(42)}
    assert len(rounds) == 2  # fingerprints and one round of hubs: a second round would have as many rows
    assert sum("key" in columns for columns in written) == 3  # keys are written once, and once a round
