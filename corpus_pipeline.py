"""A corpus from raw documents to tokens: five stages, each on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Empty tables pass all stages, as do extra columns, whatever their names. Each operator's module says how it treats nulls, long
texts, ties and repeated rows; the stages say what that means for the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrid.llm import bpe, decontaminate, quality_rules, simhash, suffix_dedup
from inkgrid.llm.common import column_of, mapped, materialise, table, texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts too, having no words. Repeated rows are judged alike."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, whose five-word shingles have a Jaccard similarity of 0.8 or more, the document with the smallest id stays.

    Repeated rows are copies, so one stays; a null id is larger than any other; of rows that share an id but not the text each is a document.
    """
    return simhash.one_of_each(docs, simhash.SimHashParams(shingle=5, distance=14, similarity=0.8))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier are cut out; n_chars is counted again. Null texts stay null, texts that lose all stay as empty ones."""
    got = suffix_dedup.cleaned(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go; null and empty texts hold none and stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and SHA-256 of the text that the ids decode to, of every row; null and empty texts have no ids."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        with bpe.lent(vocabulary) as t:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    part = b.slice(k, 64)
                    with bpe.uncollected():
                        ids = [t.encode(x.decode("utf-8", "replace")) for x in texts(column_of(part, "text"))]
                    yield pa.RecordBatch.from_arrays(
                        [column_of(part, "doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                        names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
                    )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])
    return mapped(docs.select("doc_id", "text"), run, schema)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokenized),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
