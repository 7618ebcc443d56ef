"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, toxicity
from .bpe import encode_decode
from .common import Scratch, table
from .decontamination import contaminated
from .fill_in_middle import fill_in_middle, restored
from .oracles import ORACLES  # noqa: F401
from .pii import pii_key, pseudonymise
from .prefix_trie import forked, prefix_trie
from .quality_rules import clean_lines
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .url_filter import judge_urls
from .warc_zip import read_packages, resolved, write_packages


def sha256_hex(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of what `labels` names: low quality (quality 0), which is no toxicity but tells of it, then toxic.

    Fitted on 10,000 labelled rows at most.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    links = toxicity.fit_chain(*toxicity.training_rows(docs, labels, ["low_quality", "toxic"], "doc_id", "text", most_rows=10_000))
    return toxicity.predict_chain(docs, links)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = ["example.com/en/", "net/es/", "net/fr/"]
    return judge_urls(table(spark, sf_dir, "pages"), block=block, allow=["com/", "www.example.com/en/"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_hex("kept_text").alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on about 3,000 documents a language of those whose crc32(doc_id) mod 4 is not 2. A null id has no such remainder."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out), "doc_id", "text", "lang", most_per_language=3_000)
    out = language_id.predict_languages(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block classifier and edge strength fitted on about 500 different pages."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages, "html", most_pages=500))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex("output").alias("output_sha256"), F.sha2(restored("output", "form").cast("binary"), 256).alias("restored_sha256"))


def op12_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of all pages, written, read back and removed."""
    with Scratch(spark) as keep:
        folder = f"{keep.folder}/packages"
        write_packages(table(spark, sf_dir, "pages"), folder, keep)
        rows = resolved(keep(read_packages(spark, folder)))
        return keep.result(rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations rebuilt as forks of every fifth one."""
    with Scratch(spark) as keep:
        return prefix_trie(*forked(table(spark, sf_dir, "conversations"), keep))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_pii": op10_pii,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc_zip": op12_warc_zip,
    "op13_prefix_trie": op13_prefix_trie,
}
