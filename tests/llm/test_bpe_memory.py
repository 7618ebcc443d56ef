"""The encoder's memory is bounded: it holds two generations of answers, and what is asked for often stays."""

from pulsegrid.llm import bpe


def test_answers_held_do_not_grow_with_the_distinct_keys():
    asked = []
    held = bpe.Remembered(lambda key: asked.append(key) or len(key), most=100)
    for i in range(10_000):
        assert held[f"{i}"] == len(str(i)) and held["often"] == 5
        assert len(held) <= 100 and len(held.older) <= 100
    assert asked.count("often") == 1 and len(asked) == 10_001
    assert held["x" * 300] == 300 and "x" * 300 not in held


def test_an_encoder_of_any_memory_gives_the_same_ids():
    table = bpe.PerfectHash([bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cab", b"abcab"])
    text = [f"{'abcab' * (i % 7)}{i % 41}" for i in range(500)]
    assert [bpe.Encoder(table, most=3)[t] for t in text] == [bpe.Encoder(table)[t] for t in text]
    small = bpe.Encoder(table, most=3)
    want = bpe.Encoder(table)
    assert [small[t] for t in text] == [want[t] for t in text] and len(small.pairs) + len(small.pairs.older) <= 6
