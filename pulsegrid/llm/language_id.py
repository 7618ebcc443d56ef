"""Language ID by error-correcting output codes.

Each language gets a codeword. For each bit a binary n-gram classifier is fitted: log odds of hashed byte n-grams
in the languages whose bit is 1 against those whose bit is 0. A text's margin for a bit is its n-grams' summed log
odds, tempered by the text's length; decoding takes the codeword of least loss, each bit's logistic loss weighted by
how far apart the two sides are. Texts whose two best codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SLOTS, SIZES = 1 << 14, (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Slots of the byte n-grams of the lower-cased text, each run of other than letters read as one space."""
    raw = np.frombuffer(b" " + utf8(" ".join(re.findall(r"[^\W\d_]+", text.lower()))) + b" ", np.uint8).astype(np.uint32)
    out = []
    for i, n in enumerate(SIZES):
        if len(raw) >= n:
            h = np.zeros(len(raw) - n + 1, np.uint32)
            for j in range(n):
                h = (h ^ raw[j : len(raw) - n + 1 + j]) * np.uint32(0x01000193) + np.uint32(j + 1)
            h ^= h >> np.uint32(15)
            out.append((h & np.uint32(SLOTS - 1)) + np.uint32(i * SLOTS))
    return np.concatenate(out)


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 per class: all splits for up to five classes, else the best-spread of 200 seeded random codes."""
    if classes == 0:
        return np.empty((0, 0), np.int8)
    if classes <= 5:
        columns = [c for c in product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T.reshape(classes, -1)
    rng, best, spread = np.random.default_rng(5), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, 8 * int(np.ceil(np.log2(classes)))))
        code = code[:, np.abs(code.sum(1 if classes == 1 else 0)) < classes]
        apart = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        if apart > spread:
            best, spread = code, apart
    return best


class LanguageModel:
    def __init__(self, names: list[str], counts: np.ndarray):
        """counts: a row of n-gram counts per language."""
        self.names = names
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.code = codewords(len(names))
        weights, reliability = [], []
        for bit in self.code.T:
            one, zero = share[bit > 0].mean(0), share[bit < 0].mean(0)
            odds = np.log(one) - np.log(zero)
            weights.append(odds)
            reliability.append(float(((one - zero) * odds).sum()))
        self.weights = np.array(weights, np.float32).reshape(-1, counts.shape[1]).T.copy()
        self.reliability = np.array(reliability) / max(np.mean(reliability), 1e-9) if reliability else np.empty(0)

    def predict(self, text: str | None, gap: float) -> tuple[str, float, bool]:
        if not self.names or text is None or not LETTER.search(text):
            return "und", 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        at = grams(text)
        total = np.zeros(self.weights.shape[1])
        for i in range(0, len(at), 1 << 18):
            total += self.weights[at[i : i + (1 << 18)]].sum(0, dtype=np.float64)
        margin = total / np.sqrt(len(at))
        loss = (self.reliability * np.logaddexp(0, -self.code * margin)).sum(1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(np.maximum(loss[order[0]] - loss, -700))
        return self.names[order[0]], float(1 / odds.sum()), bool(loss[order[1]] - loss[order[0]] < gap)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most_per_language: int) -> LanguageModel:
    """n-gram counts by language over about most_per_language documents of each, chosen by a hash of the id."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > most_per_language:
            share = F.when(F.col("lang") == lang, F.lit(most_per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if text:
                    own = sums.setdefault(lang, np.zeros(SLOTS * len(SIZES)))
                    own += np.bincount(grams(text), minlength=SLOTS * len(SIZES))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "counts": [sum(np.frombuffer(x) for x in part["counts"]).tobytes()]})

    sums = sample.repartition(16).mapInPandas(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary").orderBy("lang").collect()
    return LanguageModel([r.lang for r in sums], np.array([np.frombuffer(bytes(r["counts"])) for r in sums]).reshape(-1, SLOTS * len(SIZES)))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", gap: float = 1.0) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous.

    A null text, or one without a letter, is `und` with score 0; so is every text if the model knows no language.
    Every row is judged by its text alone; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.code, model.weights, model.reliability))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel.__new__(LanguageModel)
        own.names, own.code, own.weights, own.reliability = shared.value
        for batch in batches:
            out = pd.DataFrame([own.predict(t, gap) for t in batch["text"]], columns=["lang_pred", "score", "ambiguous"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
