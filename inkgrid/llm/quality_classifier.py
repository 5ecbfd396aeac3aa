"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Training reads labelled documents only, at most ``max_training_rows`` of them, chosen by a hash of the id (so the same
rows at every run). Their hashed n-grams come from the executors; the updates run on the driver over that bounded
sample. Scoring is one pass over all documents: hash, gather weights, sum. A document's features are its distinct
hashed n-grams with sublinear counts, scaled to length one.

Null and empty texts have no features and score the bias alone. Rows with a null id or label are not trained on; of rows
that share an id the smallest text is, with the larger label. Every row is scored, repeated ones each. Without any labelled row the
score is 0.5; empty tables give empty tables. Long texts make a chunk of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chained, chunks, column_of, lowered, mapped, mix, utf8_view, word_hashes, word_spans


@dataclass(frozen=True)
class ClassifierParams:
    bits: int = 18
    order: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    epochs: int = 4
    max_training_rows: int = 6000
    threshold: float = 0.7


def features(raw: np.ndarray, offs: np.ndarray, p: ClassifierParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """For ranges of documents: bounds of each document's features, indices, values, and the range."""
    for i, j in chunks(offs):
        data, own = lowered(raw[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(data, own)
        h = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        keys = []
        win = h.copy()
        for k in range(p.order):
            if k:
                win = chained(win[:-1], h[k:])
            own_doc = doc[: len(win)] if len(win) else doc[:0]
            ok = own_doc == doc[k : k + len(win)]
            keys.append((own_doc[ok].astype(np.uint64) << np.uint64(32)) | (mix(win[ok] + np.uint64(k)) >> np.uint64(64 - p.bits)))
            if len(win) < 2:
                break
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        at, index = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
        value = 1.0 + np.log(counts)
        bounds = np.searchsorted(at, np.arange(j - i + 1))
        sums = np.concatenate([[0.0], np.cumsum(value * value)])
        norm = np.sqrt(sums[bounds[1:]] - sums[bounds[:-1]])
        yield bounds, index, value / np.repeat(norm, np.diff(bounds)), i, j


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], p: ClassifierParams) -> Model:
    """FTRL-Proximal, one update a row, in the given order; the bias has no penalty."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    zb = nb = 0.0
    weigh = lambda z, n, l1, l2: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + l2))
    for _ in range(p.epochs):
        for index, value, label in rows:
            w = weigh(z[index], n[index], p.l1, p.l2)
            wb = -zb / ((p.beta + nb**0.5) / p.alpha)
            score = 1 / (1 + np.exp(-np.clip(w @ value + wb, -35, 35)))
            g = (score - label) * value
            after = n[index] + g * g
            z[index] += g - (np.sqrt(after) - np.sqrt(n[index])) / p.alpha * w
            n[index] = after
            gb = float(score - label)
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / p.alpha * wb
            nb += gb * gb
    return Model(weigh(z, n, p.l1, p.l2).astype(np.float32), float(-zb / ((p.beta + nb**0.5) / p.alpha)))


def fit(docs: DataFrame, labels: DataFrame, params: ClassifierParams | None = None, usable: Column | None = None, text: str = "text", id: str = "doc_id", label: str = "quality") -> Model:
    """Learns from the labelled documents for which ``usable`` (a condition on labels) holds."""
    p = params or ClassifierParams()
    sample = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    if usable is not None:
        sample = sample.where(usable)
    sample = sample.groupBy(id).agg(F.max(label).cast("double").alias("_label")).withColumn("_order", F.xxhash64(F.col(id))).orderBy("_order", id).limit(p.max_training_rows)
    # the bound on the rows is max_training_rows, so the sample is small enough to broadcast at any size of the input
    own = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sample = sample.select(F.col(id).alias("_of"), "_label", "_order")
    # a row an id, so that repeated ids don't multiply what comes to the driver
    chosen = own.join(F.broadcast(sample), own["_id"] == sample["_of"]).groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_order").alias("_order"), F.min("_label").alias("_label"))

    def run(batches):
        for b in batches:
            raw, offs = utf8_view(column_of(b, "_text"))
            order, label_ = column_of(b, "_order"), column_of(b, "_label")
            for bounds, index, value, i, j in features(raw, offs, p):
                yield pa.RecordBatch.from_arrays(
                    [order.slice(i, j - i), label_.slice(i, j - i), pa.array([index[x:y].astype(np.uint32).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.array([value[x:y].astype(np.float32).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["_order", "_label", "index", "value"],
                )

    got = mapped(chosen.select("_order", "_label", "_text"), run, "_order long, _label double, index binary, value binary").toArrow()
    rows = sorted(zip(got["_order"].to_pylist(), got["_label"].to_pylist(), got["index"].to_pylist(), got["value"].to_pylist()))
    if not rows:
        return Model(np.zeros(1 << p.bits, np.float32), 0.0)
    return train_ftrl([(np.frombuffer(i, np.uint32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for _, y, i, v in rows], p)


def scored(docs: DataFrame, model: Model, params: ClassifierParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, score and predicted of every row."""
    p = params or ClassifierParams()
    kind = docs.schema[id]
    model_file = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2**bits floats, whatever the input

    def run(batches):
        weights, bias = model_file.value
        for b in batches:
            raw, offs = utf8_view(column_of(b, text))
            out = [np.zeros(0)]
            for bounds, index, value, i, j in features(raw, offs, p):
                sums = np.concatenate([[0.0], np.cumsum(weights[index] * value)])
                out.append(1 / (1 + np.exp(-np.clip(sums[bounds[1:]] - sums[bounds[:-1]] + bias, -35, 35))))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([column_of(b, id), pa.array(s, pa.float64()), pa.array((s >= p.threshold).astype(np.int32), pa.int32())], names=[id, "score", "predicted"])

    return mapped(docs.select(id, text), run, T.StructType([kind, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
