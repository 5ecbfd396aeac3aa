"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (letters, digits and all non-ASCII characters; A-Z lower-cased). The CGK random walk reads a
sequence: at step t it puts out the word it stands on and moves on if a random bit of t and the word says so. Sequences
at a small edit distance agree in most outputs, so edit distance becomes Hamming distance. A key is a few sampled outputs.
Each word of a document starts a window for each class of item sizes; its walk is followed to the sampled steps, and
dropped as soon as no item has these outputs so far, which gives the same keys as the whole walk would. Walks and samples
are repeated until, on items with as many random edits as may be found, the share that meets reaches ``recall``; if
``max_repeats`` don't reach it, that is an error. Walks drift apart with length, so items of 2 * ``piece`` words or more
are indexed by pieces of ``piece`` words and more; one piece at least has no more than its share of the edits.
Candidates are verified exactly: the least edit distance of the item to any passage around the window, over its words.

Items of fewer than ``min_words`` words allow less than two edits, too few for samples to tell them from chance: they are
found where all their words stand in a row, by the hash of each row of as many words, whatever their length. Items without
a word, and null ones, are found nowhere; null texts have no words. Items go to the tasks in parts of ``part_bytes`` at most; a
larger benchmark takes a pass for each part. Repeated rows are found each; equal items each give a row. Of passages at the same
distance the first is given, wherever the document stands. Long texts make a chunk of their own. Empty tables give no leaks. Other
columns are not read by ``leaks`` and pass unchanged through ``clean_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, chained, chunks, column_of, lowered, mapped, total_bytes, utf8_view, word_hashes, word_spans


@dataclass(frozen=True)
class DecontaminationParams:
    similarity: float = 0.8
    recall: float = 0.9
    samples: int = 3
    max_repeats: int = 400
    piece: int = 32
    min_words: int = 8
    seed: int = 20240229
    part_bytes: int = 32 << 20
    trials: int = 400


#: Ends each document among its words; no walk leaves it.
PAD = np.uint64(0)
_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


def word_symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with a PAD after each document, and where each document begins (one more at the end)."""
    data = _WORD[lowered(raw)]
    starts, ends, first = word_spans(data, offs)
    h = word_hashes(data, starts, ends)
    h[h == PAD] = np.uint64(1)
    bounds = first + np.arange(len(first))
    out = np.full(bounds[-1], PAD, np.uint64)
    at = np.ones(len(out), bool)
    at[bounds[1:] - 1] = False
    out[at] = h
    return out, bounds


class Walk:
    """One repetition for one class of sizes: random bits by step and word, and the sampled steps."""

    def __init__(self, size: int, p: DecontaminationParams, turn: int):
        rng = np.random.default_rng([p.seed, size, turn])
        steps = 2 * size
        # one sample from each of as many ranges, the first from the first four steps, where it prunes soonest
        edges = [0, 4, *np.linspace(4, steps, p.samples).astype(int)[1:]]
        self.at = [int(rng.integers(a, max(a + 1, b))) for a, b in zip(edges, edges[1:])]
        self.bits = rng.integers(0, 1 << 63, steps + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def go(self, sym: np.ndarray, place: np.ndarray, a: int, b: int) -> np.ndarray:
        for t in range(a, b):
            place = place + ((sym[place] * self.bits[t]) >> np.uint64(63)).view(np.int64)  # a PAD's bit is 0
        return place

    @staticmethod
    def key(before: np.ndarray | None, out: np.ndarray) -> np.ndarray:
        """Of the outputs sampled so far; words are hashes, so the first is a key itself."""
        return out if before is None else chained(before, out)

    def keys(self, sym: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """After each sample, the key so far."""
        out, key, a = [], None, 0
        for t in self.at:
            place, a = self.go(sym, place, a, t), t
            key = self.key(key, sym[place])
            out.append(key)
        return out


def _few(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(keys)
    table = np.zeros(1 << 16, bool)
    table[(keys >> np.uint64(48)).astype(np.int64)] = True
    return keys, table


class Index:
    """Keys of the items' walks by class of sizes and repetition."""

    def __init__(self, ids: list, sequences: list[np.ndarray], p: DecontaminationParams):
        self.p, self.ids, self.sequences = p, ids, sequences
        classes: dict[int, list[tuple[int, int, int]]] = {}  # pieces: item, from, to
        short: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            if 0 < len(s) < p.min_words:
                short.setdefault(len(s), []).append(i)
            elif len(s):
                edges = np.linspace(0, len(s), max(1, len(s) // p.piece) + 1).astype(int).tolist()
                for a, b in zip(edges, edges[1:]):
                    classes.setdefault(1 << ((b - a).bit_length() - 1), []).append((i, a, b))
        self.walks = []
        for size, own in sorted(classes.items()):
            pieces = [sequences[i][a:b] for i, a, b in own]
            sym, begin = self._joined(pieces)
            origin = np.array([x[:2] for x in own])
            for turn in range(self._repeats(size, pieces)):
                w = Walk(size, p, turn)
                keys = w.keys(sym, begin)
                order = np.argsort(keys[-1], kind="stable")
                self.walks.append((w, [_few(k) for k in keys], keys[-1][order], origin[order]))

        self.rows = []  # by length of short items: their hashes in order, and the items
        for size, own in sorted(short.items()):
            keys = self._row_keys(np.concatenate([sequences[i] for i in own]), size)[::size]
            order = np.argsort(keys, kind="stable")
            self.rows.append((size, keys[order], np.array(own)[order]))

    @staticmethod
    def _row_keys(sym: np.ndarray, size: int) -> np.ndarray:
        """Of each row of size words."""
        key = sym[: max(0, len(sym) - size + 1)].copy()
        for k in range(1, size):
            key = chained(key, sym[k : k + len(key)])
        return key

    def exact(self, sym: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, end, 0) of the short items, at their first place in each document."""
        out: dict[tuple[int, int], int] = {}
        for size, keys, items in self.rows:
            own = self._row_keys(sym, size)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            at = np.flatnonzero(hi > lo)
            doc = np.searchsorted(bounds, at, "right") - 1
            for a, d in zip(at.tolist(), doc.tolist()):
                for i in items[lo[a] : hi[a]].tolist():
                    if (d, i) not in out and np.array_equal(sym[a : a + size], self.sequences[i]):
                        out[d, i] = a + size - int(bounds[d])
        return [(d, i, end, 0) for (d, i), end in out.items()]

    @staticmethod
    def _joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum([0, *(len(s) + 1 for s in sequences)])
        return np.concatenate([x for s in sequences for x in (s, [PAD])]).astype(np.uint64), begin[:-1]

    def _repeats(self, size: int, pieces: list[np.ndarray]) -> int:
        """Until edited pieces meet themselves with the recall asked for."""
        p, rng = self.p, np.random.default_rng([self.p.seed, size])
        pick = [pieces[i] for i in rng.choice(len(pieces), p.trials)]
        edited = [edit(s, int(len(s) * (1 - p.similarity)), rng) for s in pick]
        a, at_a = self._joined(pick)
        b, at_b = self._joined(edited)
        met = np.zeros(len(pick), bool)
        for turn in range(p.max_repeats):
            w = Walk(size, p, turn)
            met |= w.keys(a, at_a)[-1] == w.keys(b, at_b)[-1]
            if met.mean() >= p.recall:
                return turn + 1
        raise RuntimeError(f"decontamination: {p.max_repeats} repeats find {met.mean():.3f} of the edited items of {size} words and more, {p.recall} are asked for")

    def candidates(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, offset) of windows that share a key with the item's piece at that offset."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for w, few, last, origin in self.walks:
            begin = place = starts
            key, a = None, 0
            for t, (keys, table) in zip(w.at, few):
                place, a = w.go(sym, place, a, t), t
                key = w.key(key, sym[place])
                stay = np.flatnonzero(table[(key >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, key[stay]), len(keys) - 1)
                stay = stay[keys[at] == key[stay]]
                begin, place, key = begin[stay], place[stay], key[stay]
            lo, hi = np.searchsorted(last, key, "left"), np.searchsorted(last, key, "right")
            for k in range(int((hi - lo).max(initial=0))):
                own = lo + k < hi
                out.append(np.column_stack([begin[own], origin[lo[own] + k]]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.concatenate(out), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]


def edit(s: np.ndarray, n: int, rng) -> np.ndarray:
    """n random insertions, deletions and substitutions."""
    words = s.tolist()
    for _ in range(n):
        k, at = int(rng.integers(3)), int(rng.integers(max(1, len(words))))
        new = int(rng.integers(2, 1 << 63))
        if k == 0:
            words.insert(at, new)
        elif k == 1 and len(words) > 1:
            del words[at]
        elif words:
            words[at] = new
    return np.array(words, np.uint64)


def least_distance(item: list[int], passage: list[int]) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of the passage, and where the stretch ends: bit-parallel, columns of any length."""
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(passage):
        eq = masks.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        more, less = down | ~(d | up), up & d
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(d | more)), more & d
        if score < best:
            best, end = score, j + 1
    return best, end


def verify(index: Index, sym: np.ndarray, bounds: np.ndarray, starts: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, end of the passage in words, distance): the nearest passage of each item in each document that is near enough."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    doc = np.searchsorted(bounds, starts, "right") - 1
    starts = starts - offsets  # where the item would begin
    order = np.lexsort((items, starts))
    starts, items, doc = starts[order], items[order], doc[order]
    done: dict[tuple[int, int], int] = {}
    for s, i, d in zip(starts.tolist(), items.tolist(), doc.tolist()):
        seq = index.sequences[i]
        m = len(seq)
        most = int(m * (1 - index.p.similarity) + 1e-9)
        if (d, i) in found and found[d, i][0] == 0:
            continue  # starts come in order, so no place as near is earlier
        if (d, i) in done and done[d, i] >= s:
            continue
        lo, hi = max(int(bounds[d]), s - 2 * most - 1), min(int(bounds[d + 1]) - 1, s + m + 2 * most + 1)
        passage = sym[lo:hi]
        if np.isin(seq, passage).sum() < m - most:  # each edit spoils one of the item's words at most
            continue
        distance, end = least_distance(seq.tolist(), passage.tolist())
        done[d, i] = s + most
        end += lo - int(bounds[d])
        if distance <= most and (distance, end) < found.get((d, i), (m, 0)):
            found[d, i] = (distance, end)
    return sorted([(d, i, end, distance) for (d, i), (distance, end) in found.items()] + index.exact(sym, bounds))


def _indexes(benchmark: DataFrame, p: DecontaminationParams, text: str, id: str):
    """An index for each part of the benchmark, each of a bounded size."""
    items = benchmark.select(id, text).where(F.col(text).isNotNull())
    parts = max(1, -(-total_bytes(items, text) // p.part_bytes))
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64(id, text), F.lit(parts)) == k).orderBy(id, text).toArrow()
        raw, offs = utf8_view(got[text])
        sym, bounds = word_symbols(raw, offs)
        yield Index(got[id].to_pylist(), [sym[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:])], p)


def _search(batch: pa.RecordBatch, index: Index, text: str):
    raw, offs = utf8_view(column_of(batch, text))
    for i, j in chunks(offs):
        sym, bounds = word_symbols(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        starts = np.flatnonzero(sym != PAD)
        for d, item, end, distance in verify(index, sym, bounds, *index.candidates(sym, starts)):
            yield i + d, item, end, distance


def leaks(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, text: str = "text", id: str = "doc_id", item: str = "item_id") -> DataFrame:
    """doc id, item id, end_word, distance and similarity: each item near a passage of each document, at its nearest passage."""
    p = params or DecontaminationParams()
    schema = T.StructType([docs.schema[id], benchmark.schema[item], *(T.StructField(k, t) for k, t in (("end_word", T.LongType()), ("distance", T.LongType()), ("item_words", T.LongType()), ("similarity", T.DoubleType())))])
    out, kind = None, arrow_type(benchmark.schema, item)
    for index in _indexes(benchmark, p, text, item):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            own = sent.value
            for b in batches:
                rows = list(_search(b, own, text))
                if rows:
                    at, items, end, distance = zip(*rows)
                    words = [len(own.sequences[i]) for i in items]
                    yield pa.RecordBatch.from_arrays(
                        [column_of(b, id).take(pa.array(at)), pa.array([own.ids[i] for i in items], kind), pa.array(end, pa.int64()), pa.array(distance, pa.int64()), pa.array(words, pa.int64()), pa.array([1 - d / w for d, w in zip(distance, words)], pa.float64())],
                        names=[f.name for f in schema],
                    )

        got = mapped(docs.select(id, text), run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents in which no item was found, with all their columns; a pass for each part of the benchmark, no shuffle."""
    p = params or DecontaminationParams()
    columns = docs.columns
    for index in _indexes(benchmark, p, text, item):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in _search(b, sent.value, text)]] = False
                yield pa.RecordBatch.from_arrays(b.columns, names=columns).filter(pa.array(keep))

        docs = mapped(docs, run, docs.schema)
    return docs
