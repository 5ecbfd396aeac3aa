"""The registered queries of this subpackage, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, language_model, quality_classifier, quality_rules, simhash, sql, suffix_dedup, url_filter, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extract.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are all pages' URLs, by seed words in their hosts."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.labelled_by_seeds(pages))
    return url_filter.judged(pages, model).select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express: host, path, and the rule that fits."""
    return url_filter.ruled(table(spark, sf_dir, "pages")).drop("url")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip of every text; digests only, no ids or texts are held."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item near a passage of every document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "end_word", "distance", "item_words", "similarity")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and the components of their links."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text."""
    got = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model of those with another remainder than 2; a null id has none, so it is held out."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = language_model.scored(table(spark, sf_dir, "documents"), remainder != 2)
    rounded = (F.round(k, 6).alias(k) for k in ("base_score", "score"))  # to the digits that don't depend on the order of the sums
    return got.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules measure on every text, and their verdict."""
    return quality_rules.measured(table(spark, sf_dir, "documents"))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express."""
    return quality_rules.measured(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model of labelled ones with another remainder than 2; a null id has no label to learn, so it is held out."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), usable=remainder != 2)
    return quality_classifier.scored(docs, model).select("doc_id", F.coalesce(remainder == 2, F.lit(True)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_url_filter, op3_bpe, op4_decontamination, op5_simhash, op6_suffix_dedup, op7_warc, op8_lm_scoring, op9_quality_rules, op10_quality_classifier, url_rules, text_counts)
}

_LM = language_model.LMParams()

ORACLE_SQL: dict[str, str] = {
    "op6_suffix_dedup": sql.SUFFIX, "op7_warc": sql.WARC, "op8_lm_scoring": sql.language_model(_LM.order, _LM.prior, _LM.discount),
    "url_rules": sql.URL_RULES, "text_counts": sql.TEXT_COUNTS,
}
