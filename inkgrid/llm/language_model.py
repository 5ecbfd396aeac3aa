"""LM scoring with a weighted backoff automaton.

N-gram counts are exact over all training documents. Documents are dealt into blocks; a block asks for the counts of
its own distinct n-grams, shards of the n-grams' hash range add up what all blocks have and answer each block. So no task and no
broadcast holds the whole model, and the part of the automaton that a block gets is all its texts can reach. Keys go
sorted, as differences of as many bytes as the largest needs, counts as bytes where they fit. A block sends a row only to
shards of which it has n-grams, so there are never more rows than n-grams.

States are the n-grams seen in training that can stand before a token; an arc's weight is the log10 probability of a
token after its state; the failure arc of a state leads to its longest proper suffix and weighs the mass left for
tokens without an arc. Probabilities are smoothed by a Dirichlet prior on the next lower order; single tokens by an
absolute discount whose mass goes to the one unknown token. They sum to one after every state. A text is read once from
left to right (``Automaton.walk``): the state looks for the token's arc; where there is none, the failure arc's weight is added and its
target looks; the weight found is added and the arc's target carried on. All texts of a block walk side by side. A text of over
``piece`` tokens walks in pieces: a state says no more than the last ``order - 1`` tokens, so a piece reads those first.

Null and empty texts are one end token. Repeated rows count and are scored each; those that also share the id share a block. With no
training documents every token is unknown and the score is zero; empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chained, chunks, lowered, materialise, total_bytes, trim, utf8_view, word_hashes, word_spans

#: Stand for the start and the end of a text among words' hashes.
START, END = np.uint64(0x51A6), np.uint64(0xE4D0)
#: All bits of a hash but the lowest.
FREE = ~np.uint64(1)


@dataclass(frozen=True)
class LMParams:
    order: int = 2  # 3 needs 1.7 times the disk between stages, see the README
    prior: float = 20.0
    discount: float = 0.5
    block_bytes: int = 5 << 20
    piece: int = 2048


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different values, a place of each, and each place's number among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class Tokens:
    """The n-grams of a block's texts, as hashes by order (index 0 is order 1) at the places of their last tokens; the lowest bit is free."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, order: int):
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in chunks(offs):
            data = lowered(raw[offs[i] : offs[j]])
            starts, ends, first = word_spans(data, offs[i : j + 1] - offs[i])
            words.append(word_hashes(data, starts, ends))
            counts.append(np.diff(first))
        n_words = np.concatenate(counts)
        docs = len(n_words)
        self.bounds = np.concatenate([[0], np.cumsum(n_words + 2)])  # with a start and an end
        syms = np.empty(self.bounds[-1], np.uint64)
        inner = np.ones(len(syms), bool)
        inner[self.bounds[:-1]] = inner[self.bounds[1:] - 1] = False
        syms[self.bounds[:-1]], syms[self.bounds[1:] - 1] = START, END
        syms[inner] = np.concatenate(words) & FREE
        self.start = np.zeros(len(syms), bool)
        self.start[self.bounds[:-1]] = True
        self.doc = np.repeat(np.arange(docs, dtype=np.int32), n_words + 2)
        deep = np.arange(len(syms)) - self.bounds[self.doc] if docs else np.zeros(0, np.int64)
        self.at, self.gram, gram = [], [], syms
        for k in range(order):
            if k:
                gram = np.concatenate([gram[:1], chained(gram[:-1], syms[1:])])
            at = np.flatnonzero(deep >= k) if k else np.arange(len(syms))
            self.at.append(at)
            self.gram.append(gram[at] & FREE)

    def counted(self, k: int, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams of an order, and how often training texts have them: the free bit tells the texts apart, so one sort does."""
        marked = np.sort(self.gram[k] | training[self.doc[self.at[k]]].astype(np.uint64))
        keys = marked & FREE
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.add.reduceat((marked & ~FREE).astype(np.int64), new) if len(new) else new


class Grams(Tokens):
    """Distinct n-grams of a block by order, where they stand, and the n-grams that they end with and go on from."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, order: int):
        super().__init__(raw, offs, order)
        self.keys, self.id, self.suffix, self.context, self.last = [], [], [], [], []
        for k, (at, gram) in enumerate(zip(self.at, self.gram)):
            keys, place, number = distinct(gram)
            ids = np.full(len(self.doc), -1, np.int32)
            ids[at] = number
            self.keys.append(keys)
            self.id.append(ids)
            self.last.append(self.id[0][at[place]])
            self.suffix.append(self.id[k - 1][at[place]] if k else None)
            self.context.append(self.id[k - 1][at[place] - 1] if k else None)

    def counts(self, k: int, training: np.ndarray) -> np.ndarray:
        ids = self.id[k]
        use = training[self.doc] & (ids >= 0)
        return np.bincount(ids[use], minlength=len(self.keys[k])).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, of as many bytes as the largest needs."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    step = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more follow whole."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins among sorted keys (one more at the end)."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block, from the training counts of each order."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, p: LMParams):
        self.grams, self.p = grams, p
        order, words = len(counts), len(grams.keys[0])
        known = counts[0] > 0
        unknown = p.discount * types / tokens if tokens else 1.0
        self.unknown = float(np.log10(unknown)) if unknown > 0 else -np.inf
        self.words = np.uint64(words)
        # state 0 knows nothing of what was before; those of n-grams of order k + 1 begin at base[k]
        base = np.cumsum([1, *(len(c) for c in counts)])
        self.suffix, self.fail = np.zeros(base[-2], np.int64), np.zeros(base[-2])
        keys, weights, targets = [], [], []
        prob = np.where(known, (counts[0] - p.discount) / max(tokens, 1), unknown)
        for k in range(order):
            if k:
                before = counts[k - 1][grams.context[k]]
                prob = np.where(before > 0, (counts[k] + p.prior * prob[grams.suffix[k]]) / (before + p.prior), prob[grams.suffix[k]])
            ids = np.flatnonzero(counts[k] > 0)
            source = base[k - 1] + grams.context[k][ids] if k else np.zeros(len(ids), np.int64)
            keys.append(source.astype(np.uint64) * self.words + grams.last[k][ids].astype(np.uint64))
            weights.append(np.log10(np.maximum(prob[ids], 1e-300)))
            if k + 1 < order:
                states = base[k] + np.arange(len(counts[k]))
                self.suffix[states] = base[k - 1] + grams.suffix[k] if k else 0
                self.fail[states] = np.log10(p.prior / (counts[k] + p.prior)) * (counts[k] > 0)
                targets.append(base[k] + ids)
            else:
                targets.append(base[k - 1] + grams.suffix[k][ids] if k else np.zeros(len(ids), np.int64))
        keys, weights, targets = (np.concatenate(x) for x in (keys, weights, targets))
        by = np.argsort(keys)
        self.keys, self.weights, self.targets = keys[by], weights[by], targets[by]
        start = np.flatnonzero(grams.keys[0] == START)
        self.start = int(base[0] + start[0]) if len(start) and order > 1 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and next state of each walker that reads its word."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        at, state, word = np.arange(len(state)), state.copy(), word.astype(np.uint64)
        while len(at):
            key = state.astype(np.uint64) * self.words + word
            j = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[j] == key if len(self.keys) else np.zeros(len(at), bool)
            weight[at[hit]] += self.weights[j[hit]]
            after[at[hit]] = self.targets[j[hit]]
            lost = ~hit & (state == 0)
            weight[at[lost]] += self.unknown
            on = ~hit & ~lost
            weight[at[on]] += self.fail[state[on]]
            at, state, word = at[on], self.suffix[state[on]], word[on]
        return weight, after

    def walk(self) -> np.ndarray:
        """The log10 probability of each text."""
        g, lead = self.grams, self.p.order - 1
        size = np.diff(g.bounds) - 1  # tokens; a start stands before them
        pieces = np.maximum(1, -(-size // self.p.piece))
        doc = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = g.bounds[doc] + 1 + nth * self.p.piece
        end = np.minimum(begin + self.p.piece, g.bounds[doc + 1])
        read = np.where(nth > 0, lead, 0)  # tokens that only set the state
        begin = begin - read
        by = np.argsort(begin - end, kind="stable")  # the longest first, so that walkers end in order
        doc, begin, length, read = doc[by], begin[by], (end - begin)[by], read[by]
        state, total = np.where(read > 0, 0, self.start), np.zeros(len(doc))
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, "left"))  # those longer than t
            weight, state[:m] = self.step(state[:m], g.id[0][begin[:m] + t])
            total[:m] += np.where(t >= read[:m], weight, 0.0)
        return np.bincount(doc, total, len(size))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(values, 0.0), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def scored(docs: DataFrame, training: Column, params: LMParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows where training holds."""
    p = params or LMParams()
    base = docs.select(F.col(id), F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("training"))
    n = max(1, -(-total_bytes(base, "_text") // p.block_bytes))
    base = base.withColumn("_block", F.pmod(F.xxhash64(id, "_text"), F.lit(n)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        raw, offs = utf8_view(t["_text"])
        g, use, block = Tokens(raw, offs, p.order), t["training"].to_numpy(), t["_block"][0].as_py()
        found, counts = zip(*(g.counted(k, use) for k in range(p.order)))
        bounds, rows = [shard_bounds(keys, n) for keys in found], []
        for s in range(n):
            own = [slice(b[s], b[s + 1]) for b in bounds]
            if any(x.stop > x.start for x in own):
                rows.append((s, block, [packed(keys[x]) for keys, x in zip(found, own)], [packed_counts(c[x]) for c, x in zip(counts, own)]))
        trim()
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())))], names=["shard", "block", "keys", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        blocks, shard, tokens, types = t["block"].to_pylist(), t["shard"][0].as_py(), 0, 0
        totals: list[list[bytes]] = [[] for _ in blocks]
        for k in range(p.order):
            keys = [unpacked(x[k].as_py()) for x in t["keys"]]
            counts = [unpacked_counts(x[k].as_py(), len(own)) for x, own in zip(t["counts"], keys)]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, inverse, np.concatenate(counts))
            if k == 0:
                real = found != START
                tokens, types = int(total[real].sum()), int((total[real] > 0).sum())
            at = np.cumsum([0, *map(len, keys)])
            for out, x, y in zip(totals, at[:-1], at[1:]):
                out.append(packed_counts(total[inverse[x:y]]))
        trim()
        out = [*((b, shard, x, 0, 0) for b, x in zip(blocks, totals)), (-1, shard, [], tokens, types)]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64()))], names=["block", "shard", "totals", "tokens", "types"])

    asked = base.groupBy("_block").applyInArrow(ask, "shard int, block int, keys array<binary>, counts array<binary>")
    answers = materialise(asked.groupBy("shard").applyInArrow(answer, "block int, shard int, totals array<binary>, tokens long, types long"), "lm-counts")
    whole = answers.where("block < 0").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = int(whole["n"] or 0), int(whole["v"] or 0)

    kinds = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        raw, offs = utf8_view(t["_text"])
        g = Grams(raw, offs, p.order)
        got = got.sort_by("shard")  # shards are ranges, so their answers follow each other
        shards, counts = got["shard"].to_numpy(), []
        for k, keys in enumerate(g.keys):
            size = np.diff(shard_bounds(keys, n))
            counts.append(np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(x[k].as_py(), int(size[s])) for x, s in zip(got["totals"], shards))]))
        of = counts[0][g.id[0]]
        plain = np.where(g.start, 0.0, np.log10((of + 1) / (tokens + types + 1)))
        cols = [np.diff(g.bounds) - 1, _sums(((of > 0) & ~g.start).astype(float), g.bounds).astype(np.int64), np.full(len(t), tokens), _sums(plain, g.bounds), Automaton(g, counts, tokens, types, p).walk()]
        trim()
        return pa.Table.from_arrays([t[id], t["training"], *(pa.array(c, kind) for c, (_, kind) in zip(cols, kinds))], names=[id, "training", *(k for k, _ in kinds)])

    schema = T.StructType([docs.schema[id], T.StructField("training", T.BooleanType()), *(T.StructField(k, T.LongType() if kind == pa.int64() else T.DoubleType()) for k, kind in kinds)])
    replies = answers.where("block >= 0").select(F.col("block").alias("_block"), "shard", "totals")
    return base.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(score, schema)
