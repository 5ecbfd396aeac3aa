"""Suffix-array dedup: exact removal of passages that also start earlier, by column-wise construction.

A byte goes if it lies in a string of ``length`` bytes that also starts at an earlier place of the corpus: in a smaller
document id, or earlier in the same document. Strings never cross documents.

How the suffixes that can matter are brought together: every string of ``length`` bytes has an anchor, the gram of
``gram`` bytes in it with the smallest hash (the leftmost of equals), so equal strings have the same anchor at the same
offset. An occurrence of an anchor is a segment: the text around it that all strings with this anchor lie in. Segments
that are equal as a whole (their anchors' hashes and 62 bits at points drawn for the run agree, see ``SoundHash``) are one
kind: all but the earliest are repeats. Anchors with several kinds are settled by the collection's Burrows-Wheeler transform and
longest common prefixes, built column by column over one segment of each kind; what one task holds is one collection. Each
round inserts one symbol of every segment (from the right), and rewrites transform and prefixes in sequence, in external
files beyond ``memory_rows``. Suffixes in a row whose common prefixes reach ``length`` are one string; all but its earliest
occurrence are repeats. Anchors with too many kinds for one task (``hot_kinds``) are settled string by string with a
partial aggregate instead, by 128-bit hashes (the same result).

Null and empty texts have no bytes to remove. Rows that repeat an id and its text are one document and lose the same
bytes. Of rows with the same id and other texts, and of rows without an id, see ``_numbered``. Empty tables give empty
tables. Texts over ``piece_bytes`` are read in overlapping pieces. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SoundHash, chunks, column_of, mapped, materialise, mix, prefix_hashes, span_hashes, utf8_view


@dataclass(frozen=True)
class SuffixParams:
    length: int = 100
    gram: int = 40
    hot_kinds: int = 3000
    task_segments: int = 8_000
    memory_rows: int = 1 << 18
    flush_rows: int = 1 << 18
    chunk_bytes: int = 1 << 18
    piece_bytes: int = 1 << 20


def anchors(data: np.ndarray, offs: np.ndarray, p: SuffixParams, sound: SoundHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor's hash, segment's hash, segment's start and end, anchor's place in it) of every anchor, in page order.

    A segment is what all strings with this anchor cover together; strings are those for which this gram is smallest.
    """
    k, w = p.gram, p.length - p.gram + 1
    sums = prefix_hashes(data)
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < p.length:
        return none
    at = np.arange(n - k + 1)
    gram = span_hashes(sums, at, at + k)
    # the leftmost smallest gram of each window of w grams, by doubling; the place is packed below the hash
    packed = (gram & ~np.uint64((1 << 23) - 1)) | (at & ((1 << 23) - 1)).astype(np.uint64)
    low, span = packed, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    own = np.flatnonzero(doc[: n - p.length + 1] == doc[p.length - 1 :])  # strings inside one document
    if not len(own):
        return none
    place = (low[own] & np.uint64((1 << 23) - 1)).astype(np.int64)
    change = np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(own)]]) - 1
    start, end = own[first], own[last] + p.length
    anchor = place[first]
    offset = anchor - start
    name = gram[anchor]
    return doc[start], name, mix(sound.spans(data, start, end) ^ (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), start, end, offset


class Column:
    """An array that is rewritten in sequence each round: in memory, or in a file beyond a bound."""

    def __init__(self, dtype, bound: int, folder: str | None):
        self.dtype, self.bound, self.folder, self.data, self.path, self.turn = np.dtype(dtype), bound, folder, np.zeros(0, dtype), None, 0

    def insert(self, at: np.ndarray, values: np.ndarray) -> None:
        """Puts values at their places in the new array, the old ones around them in order; at is sorted."""
        n = len(self.data) + len(at)
        if n <= self.bound:
            keep = np.ones(n, bool)
            keep[at] = False
            new = np.empty(n, self.dtype)
            new[at], new[keep] = values, self.data
            self.data = new
            return
        path, step = os.path.join(self.folder, f"{id(self)}-{self.turn}"), self.bound
        self.turn += 1
        read = 0
        with open(path, "wb") as f:
            for a in range(0, n, step):
                b = min(n, a + step)
                i, j = np.searchsorted(at, [a, b])
                part = np.empty(b - a, self.dtype)
                keep = np.ones(b - a, bool)
                keep[at[i:j] - a] = False
                part[at[i:j] - a] = values[i:j]
                old = int(keep.sum())
                part[keep] = self.data[read : read + old]
                read += old
                part.tofile(f)
        before, self.path = self.path, path
        self.data = np.memmap(path, self.dtype, "r+")
        if before:
            os.remove(before)


#: A row of the transform: its symbol's code (0: none, the row is a text's start), common prefix, and text and start as one number.
_LCP, _NAMED = np.uint64(16), np.uint64(24)


def _rows(code: np.ndarray, lcp: np.ndarray, named: np.ndarray) -> np.ndarray:
    return code.astype("<u8") | lcp.astype("<u8") << _LCP | named.astype("<u8") << _NAMED


def _fields(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and common prefixes of rows, without copying."""
    return rows.view("<u2")[::4], rows.view(np.uint8)[2::8]


def _ranks(codes: np.ndarray, few: bool, queries: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted places: how many equal symbols stand before each, and the nearest equal symbols' places before and after (-1: none).

    Reads the codes in sequence; few: they fit into a byte.
    """
    rank, before, after = (np.full(len(queries), v, np.int64) for v in (0, -1, -1))
    seen, latest = np.zeros(257, np.int64), np.full(257, -1, np.int64)
    open_: dict[int, int] = {}  # symbol: index of the query that waits for its next place
    for a in range(0, len(codes), block):
        part = codes[a : a + block].astype(np.uint8 if few else np.uint16)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=257)
        starts = np.concatenate([[0], np.cumsum(counts)])
        for c in list(open_):
            if counts[c]:
                after[open_.pop(c)] = a + order[starts[c]]
        i, j = np.searchsorted(queries, [a, a + len(part)])
        if j > i:
            who = np.arange(i, j)
            where = np.empty(len(part), np.int32)
            where[order] = np.arange(len(part), dtype=np.int32)
            k, sym = where[queries[i:j] - a].astype(np.int64), part[queries[i:j] - a]
            rank[who] = k - starts[sym] + seen[sym]
            first, final = k == starts[sym], k == starts[sym.astype(np.int64) + 1] - 1
            before[who] = np.where(first, latest[sym], a + order[np.maximum(k - 1, 0)])
            after[who] = np.where(final, -1, a + order[np.minimum(k + 1, len(part) - 1)])
            for c, x in zip(sym[final].tolist(), who[final].tolist()):
                open_[c] = x
        has = np.flatnonzero(counts)
        latest[has] = a + order[starts[has + 1] - 1]
        seen += counts
    return rank, before, after


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of lcp[low:high] for each pair; 0 < high - low."""
    out = np.zeros(len(low), lcp.dtype)
    for a in range(0, len(low), 4096):
        x, y = low[a : a + 4096], high[a : a + 4096]
        base, top = int(x.min()), int(y.max())
        part = np.append(np.asarray(lcp[base:top]), lcp.dtype.type(255))
        out[a : a + 4096] = np.minimum.reduceat(part, np.stack([x - base, y - base], 1).ravel())[::2]
    return out


def collection(texts: list[bytes], p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, same) of all suffixes of a collection in their order; same: shares ``length`` bytes with the one before.

    Texts end with terminators smaller than any symbol that differ from each other, so common prefixes end there.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts])
    longest = int(size.max(initial=0))
    used = np.unique(np.frombuffer(b"".join(texts), np.uint8))
    code = np.zeros(256, np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    few = len(used) < 256
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        table = Column("<u8", p.memory_rows, folder)
        grid = np.zeros((n, longest + 1), np.uint8 if few else np.uint16)  # right-aligned codes; column 0 is never a symbol
        for i, t in enumerate(texts):
            grid[i, longest + 1 - len(t) :] = code[np.frombuffer(t, np.uint8)]
        # round zero: the terminators, in order of the texts; each stands with the symbol before it
        own = np.arange(n)
        table.insert(own, _rows(grid[:, longest], np.zeros(n, np.uint8), own * (longest + 1) + size))
        totals = np.bincount(grid[:, longest], minlength=257)
        place = own.copy()  # of each text's latest suffix
        for turn in range(1, longest + 1):
            active = own[grid[:, longest + 1 - turn] > 0]
            if not len(active):
                break
            sorted_by = np.argsort(place[active])
            active = active[sorted_by]
            queries = place[active]
            codes, lcp = _fields(table.data)
            rank, before, after = _ranks(codes, few, queries)
            sym = codes[queries]
            totals[0] = 0  # rows without a symbol lead nowhere
            first = n + np.concatenate([[0], np.cumsum(totals)])[sym]
            new = first + rank
            up = np.minimum
            cap = p.length
            value = np.zeros(len(active), np.uint8)
            has = np.flatnonzero(before >= 0)
            value[has] = up(_least(lcp, before[has] + 1, queries[has] + 1).astype(np.int64) + 1, cap)
            nxt = np.flatnonzero(after >= 0)
            below = up(_least(lcp, queries[nxt] + 1, after[nxt] + 1).astype(np.int64) + 1, cap).astype(np.uint8)
            # ``new`` counts rows as after this round; the row that follows in the new order is the next equal symbol's
            order = np.argsort(new)
            nsym = grid[active, longest - turn]
            table.insert(new[order], _rows(nsym, value, active * (longest + 1) + size[active] - turn)[order])
            _fields(table.data)[1][new[nxt] + 1] = below
            totals = totals + np.bincount(nsym, minlength=257)
            # rows from before this round moved down by those put in above them
            place[active] = new
        rows = np.array(table.data)
        return (*np.divmod((rows >> _NAMED).astype(np.int64), longest + 1), _fields(rows)[1] >= min(p.length, 255))


def repeats(segments: list[bytes], earlier: np.ndarray, p: SuffixParams) -> list[np.ndarray]:
    """For each segment the starts of its strings that another segment of the collection holds at an earlier place.

    earlier: the segments' places in the corpus, comparable as (document, byte) rows; a string's place is its segment's plus its start.
    Strings at the same place, of a repeated row or of segments that overlap, are one string.
    """
    who, start, same = collection(segments, p)
    size = np.array([len(s) for s in segments])
    whole = np.flatnonzero(size[who] - start >= p.length)
    out: list[list[int]] = [[] for _ in segments]
    if len(whole):
        # a row begins another string unless all rows since the last whole one share their prefixes
        breaks = np.cumsum(~same)
        group = breaks[whole]
        doc, byte = earlier[who[whole], 0], earlier[who[whole], 1] + start[whole]
        order = np.lexsort((byte, doc, group))
        g = group[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))]
        repeat = (doc[order] != doc[first]) | (byte[order] != byte[first])
        for r in whole[order[repeat]]:
            out[who[r]].append(int(start[r]))
    return [np.array(sorted(x), np.int64) for x in out]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal spans that strings at sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of from, to) in order, joined where they overlap or touch."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(spans[1:, 0] > reach[:-1]) + 1
    return np.stack([spans[np.concatenate([[0], cut]), 0], reach[np.concatenate([cut - 1, [len(spans) - 1]])]], 1)


#: Kinds of rows: one of each kind of segment, a repeat as a whole, one of several kinds of an anchor.
ONE, LATE, SEVERAL = 0, 1, 2
_ROW = "name long, seg long, doc long, start int, size short, kind byte"
_NAMES = ["name", "seg", "doc", "start", "size", "kind"]


def _pieces(data: np.ndarray, offs: np.ndarray, p: SuffixParams, sound: SoundHash):
    """Anchors of chunks of documents; a document beyond piece_bytes in pieces that share length - 1 bytes (row, name, seg, start, end)."""
    for i, j in chunks(offs, p.chunk_bytes):
        if offs[j] - offs[i] <= p.piece_bytes:
            d, name, seg, start, end, _ = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p, sound)
            own = offs[i:j][d] - offs[i] if len(d) else d
            yield i + d, name, seg, start - own, end - own
            continue
        for a in range(int(offs[i]), int(offs[j]), p.piece_bytes):
            part = data[a : min(int(offs[j]), a + p.piece_bytes + p.length - 1)]
            d, name, seg, start, end, _ = anchors(part, np.array([0, len(part)]), p, sound)
            yield i + d, name, seg, start + a - offs[i], end + a - offs[i]


def _first_of_kinds(batches, p: SuffixParams, points: tuple[int, int]):
    """Per task: the earliest segment of each kind, and the others as late, which no name brings together again."""
    held: list[tuple[np.ndarray, ...]] = []
    sound = SoundHash(points)

    def flush():
        if not held:
            return
        doc, name, seg, start, end = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((start, doc, seg, name))
        doc, name, seg, start, size = doc[order], name[order], seg[order], start[order], (end - start)[order]
        same = np.concatenate([[False], (name[1:] == name[:-1]) & (seg[1:] == seg[:-1])])
        again = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])  # a repeated row
        kind = np.where(same, LATE, ONE)
        name = np.where(same, mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.view(np.uint64)), name)
        keep = np.flatnonzero(~again)
        for a in range(0, len(keep), 1 << 16):
            i = keep[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[i], k) for x, k in ((name.view(np.int64), pa.int64()), (seg.view(np.int64), pa.int64()), (doc, pa.int64()), (start, pa.int32()), (size, pa.int16()), (kind, pa.int8()))], names=_NAMES)

    rows = 0
    for b in batches:
        raw, offs = utf8_view(column_of(b, "_text"))
        ids = column_of(b, "_doc").to_numpy(zero_copy_only=False)
        for row, name, seg, start, end in _pieces(raw, offs, p, sound):
            if len(row):
                held.append((ids[row].astype(np.int64), name.astype(np.uint64), seg.astype(np.uint64), start.astype(np.int64), end.astype(np.int64)))
                rows += len(row)
        if rows > p.flush_rows:
            yield from flush()
            rows = 0
    yield from flush()


def _kinds(batches, p: SuffixParams):
    """Rows come by name, segment, document and start. Drops anchors of one kind; marks repeats as late."""
    tail: pa.Table | None = None
    split = None  # a name of which rows were passed on already: it has several kinds, or may have
    before = None  # its last row's segment

    def settled(t: pa.Table, more: int | None):
        nonlocal before
        name, seg, late, doc, start = (t[k].to_numpy() for k in ("name", "seg", "kind", "doc", "start"))
        late = late == LATE
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (seg[1:] != seg[:-1])])
        if before is not None and (int(name[0]), int(seg[0])) == before:
            new[0] = False
        before = (int(name[-1]), int(seg[-1]))
        group = np.concatenate([[0], np.cumsum(name[1:] != name[:-1])])
        several = (np.bincount(group[new & ~late], minlength=group[-1] + 1)[group] > 1) | (name == split if split is not None else False) | (name == more if more is not None else False)
        twice = ~new & np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
        kind = np.where(late | ~new, LATE, np.where(several, SEVERAL, ONE))
        keep = np.flatnonzero((kind != ONE) & ~(twice & ~late))
        return pa.RecordBatch.from_arrays([*(t[k].combine_chunks().take(pa.array(keep)) for k in _NAMES[:-1]), pa.array(kind[keep], pa.int8())], names=_NAMES)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if tail is None else pa.concat_tables([tail, t]).combine_chunks()
        names = t["name"].to_numpy()
        cut = int(np.searchsorted(names, names[-1], "left"))
        more = None
        if not cut and len(t) > 4 * p.hot_kinds:
            cut, more = len(t), int(names[-1])
        if cut:
            yield settled(t.slice(0, cut), more)
            split = more if more is not None else None
        tail = t.slice(cut).combine_chunks() if cut < len(t) else None
    if tail is not None and len(tail):
        yield settled(tail, None)


def _segments(batches):
    """The bytes of the wanted segments of each document."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["name", "doc", "start", "bytes"])

    for b in batches:
        raw, offs = utf8_view(column_of(b, "_text"))
        ids, rows = column_of(b, "doc").to_pylist(), []
        for i, want in enumerate(column_of(b, "want")):
            text = raw[offs[i] : offs[i + 1]]
            for w in want.as_py():
                rows.append((w["name"], ids[i], w["start"], text[w["start"] : w["start"] + w["size"]].tobytes()))
            if len(rows) > 5000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def _strings(batches, p: SuffixParams):
    for b in batches:
        for d, s, x in zip(*(column_of(b, k).to_pylist() for k in ("doc", "start", "bytes"))):
            starts = np.arange(len(x) - p.length + 1)
            keys = [hashlib.blake2b(x[i : i + p.length], digest_size=16).digest() for i in starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.full(len(keys), d)), pa.array((starts + s).astype(np.int32))], names=["key", "doc", "start"])


def _columns(batches, p: SuffixParams):
    """Collections of whole anchors; the spans that their repeats cover."""

    def spans(t: pa.Table):
        doc, at = t["doc"].to_numpy(), t["start"].to_numpy().astype(np.int64)
        got = repeats(t["bytes"].to_pylist(), np.stack([doc, at], 1), p)
        rows = [(d, s + a, s + b) for d, s, starts in zip(doc.tolist(), at.tolist(), got) for a, b in runs(starts, p.length)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "a", "b"])

    held = list(batches)  # about task_segments rows and one anchor more, of at most 2 * length bytes each
    if held:
        yield from spans(pa.Table.from_batches(held))


def removed_spans(base: DataFrame, params: SuffixParams | None = None) -> DataFrame:
    """_doc and spans (an array of from and to, in no order) of the documents that lose bytes; base has _doc and _text."""
    p = params or SuffixParams()
    points = SoundHash.draw()
    found = mapped(base.select("_doc", "_text"), lambda it: _first_of_kinds(it, p, points), _ROW)
    settled = materialise(mapped(found.repartition("name").sortWithinPartitions("name", "seg", "doc", "start"), lambda it: _kinds(it, p), _ROW), "kinds")
    spans = settled.where(F.col("kind") == LATE).select("doc", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    wanted = settled.where(F.col("kind") == SEVERAL).groupBy("doc").agg(F.collect_list(F.struct("name", "start", "size")).alias("want"))
    cut = wanted.join(base, wanted["doc"] == base["_doc"]).select("doc", "want", "_text")
    cut = materialise(mapped(cut, _segments, "name long, doc long, start int, bytes binary"), "segments")
    hot = materialise(cut.groupBy("name").count().where(F.col("count") > p.hot_kinds).select("name"), "hot-anchors")
    cold = cut
    if hot.limit(1).count():
        cold = cut.join(hot, "name", "left_anti")
        strings = materialise(mapped(cut.join(hot, "name", "left_semi"), lambda it: _strings(it, p), "key binary, doc long, start int"), "strings")
        least = materialise(strings.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "least")
        again = strings.join(least, "key").where((F.col("doc") != F.col("least.doc")) | (F.col("start") != F.col("least.start")))
        spans = spans.unionByName(again.select("doc", F.col("start").alias("a"), (F.col("start") + p.length).alias("b")))
    tasks = max(1, -(-cut.count() // p.task_segments))  # by work: the rows are small, the columns are not
    spans = spans.unionByName(mapped(cold.repartition(tasks, "name"), lambda it: _columns(it, p), "doc long, a int, b int"))
    return spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnRenamed("doc", "_doc")


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (with columns _id and _text) with _doc, a key in the order of ids, and whether ids repeat.

    Of rows that share an id but not the text, the one with the smallest text hash keeps the id; the others, and rows
    without an id, come after all ids, in order of a hash.
    """
    value = F.col("_id").cast("long")
    last = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("_id", "_text"), 3)
    if not docs.groupBy("_id").count().where(F.col("count") > 1).limit(1).count():
        return docs.withColumn("_doc", F.coalesce(value, last)), False
    low = materialise(docs.where(F.col("_id").isNotNull()).groupBy(F.col("_id").alias("_same")).agg(F.min(F.xxhash64("_text")).alias("_low"), F.count("*").alias("_n")).where("_n > 1").select("_same", "_low"), "repeated-ids")
    joined = docs.join(low, docs["_id"] == low["_same"], "left")
    return joined.withColumn("_doc", F.when(value.isNull() | (F.xxhash64("_text") != F.col("_low")), last).otherwise(value)).drop("_same", "_low"), True


def _cut(docs: DataFrame, p: SuffixParams, text: str, id: str, keep: list[str], valid: bool = False) -> DataFrame:
    """The columns keep as c0, c1 and so on, with _kept (bytes), _n_bytes, _n_removed and _n_spans.

    valid: _kept is text, without the stumps of cut code points, and null where nothing was cut; made here, since a second Python
    function over the texts would give each task a second worker, which keeps its memory into the stages that follow.
    """
    at = docs.columns.index
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = [f"c{at(k)}" for k in keep]
    base, repeated = _numbered(named.select(*dict.fromkeys(own), F.col(f"c{at(id)}").alias("_id"), F.coalesce(F.col(f"c{at(text)}"), F.lit("")).alias("_text")))
    once = base.select("_doc", "_text")
    gone = removed_spans(once.dropDuplicates(["_doc"]) if repeated else once, p).withColumnRenamed("_doc", "_of")
    joined = base.join(gone, base["_doc"] == gone["_of"], "left").select(*dict.fromkeys(own), "_text", "spans")
    own = list(dict.fromkeys(own))
    kind = pa.string() if valid else pa.binary()

    def run(batches):
        for b in batches:
            raw, offs = utf8_view(column_of(b, "_text"))
            spans = column_of(b, "spans")
            for lo in range(0, b.num_rows, 256):
                out, n_removed, n_spans = [], [], []
                for i in range(lo, min(lo + 256, b.num_rows)):
                    data = raw[offs[i] : offs[i + 1]]
                    got = spans[i].as_py()
                    cut = merged(np.array([(x["a"], x["b"]) for x in got], np.int64)) if got else np.zeros((0, 2), np.int64)
                    if len(cut):
                        stay = np.zeros(len(data) + 1, np.int64)
                        np.add.at(stay, cut[:, 0], 1)
                        np.add.at(stay, cut[:, 1], -1)
                        left = data[np.cumsum(stay[:-1]) == 0].tobytes()
                        out.append(left.decode("utf-8", "ignore") if valid else left)
                        n_removed.append(len(data) - len(left))
                    else:
                        out.append(None if valid else data.tobytes())
                        n_removed.append(0)
                    n_spans.append(len(cut))
                hi = min(lo + 256, b.num_rows)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(column_of(part, k) for k in own), pa.array(out, kind), pa.array(np.diff(offs[lo : hi + 1])), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())], names=[*own, "_kept", "_n_bytes", "_n_removed", "_n_spans"])

    schema = T.StructType([*(named.schema[k] for k in own), T.StructField("_kept", T.StringType() if valid else T.BinaryType()), *(T.StructField(k, T.LongType()) for k in ("_n_bytes", "_n_removed", "_n_spans"))])
    return mapped(joined, run, schema)


def deduplicated(docs: DataFrame, params: SuffixParams | None = None, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """keep (default the id), kept bytes, n_bytes, n_removed and n_spans of every row."""
    keep = keep or [id]
    got = _cut(docs, params or SuffixParams(), text, id, keep)
    return got.select(*(F.col(f"c{docs.columns.index(k)}") for k in keep), "_kept", "_n_bytes", "_n_removed", "_n_spans").toDF(*keep, "kept", "n_bytes", "n_removed", "n_spans")


def cleaned(docs: DataFrame, params: SuffixParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All documents with their columns, the repeated passages taken out of their texts.

    A code point that loses some of its bytes goes as a whole; null texts stay null. A document that had text keeps its row
    even where nothing of the text is left.
    """
    got, place = _cut(docs, params or SuffixParams(), text, id, docs.columns, True), f"c{docs.columns.index(text)}"
    new = F.when(F.col(place).isNotNull(), F.when(F.col("_n_removed") == 0, F.col(place)).otherwise(F.col("_kept")))
    return got.select(*(new.alias(k) if k == place else F.col(k) for k in (f"c{i}" for i in range(len(docs.columns))))).toDF(*docs.columns)
