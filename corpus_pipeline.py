"""From raw documents to token ids: quality rules, near-dedup, decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of `documents`, and all stages
but the last return those columns. run() joins them; a driver may write each result and hand it on reread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import encode_decode
from pulsegrid.llm.common import small_batches, table
from pulsegrid.llm.decontamination import contaminated
from pulsegrid.llm.pii import pii_key, pseudonymise
from pulsegrid.llm.quality_rules import clean_lines
from pulsegrid.llm.set_dedup import near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail; n_chars follows the text. A null text is rejected."""
    small_batches(spark)
    kept = clean_lines(docs, keep=("lang", "source")).where("kept")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates.

    Links: a Jaccard similarity of 0.8 or more of the distinct five-word shingles, all of them and exactly. Rows of
    one id are one document: they stay or go together. A document without an id stays.
    """
    small_batches(spark)
    groups = near_copies(docs, shingle=5, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. A document without an id stays."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for its valid numbers, dates and e-mail names; n_chars follows the text."""
    out = pseudonymise(docs, pii_key(spark), keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that they decode to."""
    small_batches(spark)
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

#: Pattern-valued Feistel networks and BPE merges have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
