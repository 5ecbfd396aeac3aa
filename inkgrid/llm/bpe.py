"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

``sufficient_lookahead`` reads from the merge list how far to the right of a place the bytes can change what stands
to its left. A merge of rank r moves that frontier left by its left part's length, and only a later merge, whose right
part begins with that left part, can move it on. So the longest chain of such merges bounds the lookahead. A token
that ends at least that far before the end of the bytes read is stable and is emitted; what follows it is encoded anew,
which gives the same tokens, since no merge crosses the boundary. Memory holds a window of bytes and bounded caches.

Two tokens stand side by side where no merge joins bytes of both before the merges inside them are done; that is read off
the trees of merges that make the tokens (``_follows``). The result of all merges is the one sequence of which any two neighbours
stand so, which one pass from left to right finds (``_settle``).

Text arrives in pieces of any size (``encode_stream``) and is cut into units of the pattern as soon as no later character can
change them; each unit goes through ``stream``. Short units' tokens are remembered in bounded caches, together with
what stands around them up to single spaces, which the pattern can't join. A special token's text is that token. Decoding turns ids
to bytes and bytes to text by a state machine that holds at most three bytes.

Null texts are empty and have no ids. Rows are encoded one by one, so repeated rows and null ids give a row each; empty tables give
empty tables; long texts pass in windows, and ``digests`` holds neither their ids nor their decoded text. Other columns are not read.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column_of, mapped, texts

#: Unicode's White_Space, as the pattern's \\s means it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Characters that encode_stream() takes at once.
WINDOW = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that settle it, for merges in order of rank."""
    farthest: dict[bytes, int] = {}  # by left part: the longest way the frontier goes by a chain that ends with it
    most = longest = 0
    for left, right in merges:
        reach = len(left) + max((farthest.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        farthest[left] = max(farthest.get(left, 0), reach)
        most, longest = max(most, reach), max(longest, len(left) + len(right))
    return most + longest


class Transducer:
    """Encodes and decodes with one vocabulary file; ids are as that of the tokenizers library."""

    def __init__(self, path: str, window: int = 1 << 12, entries: int = 100_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_alphabet()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in byte for c in k)}
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.ends: tuple[dict, dict] = {}, {}
        self.lookahead = sufficient_lookahead(merges)
        self.window = max(window, 4 * self.lookahead)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * n
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i) for i in range(n)]
        self.longest = max(map(len, self.bytes_of))
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.crowded = regex.compile(rf" [{WHITE}]|[{WHITE}] ")
        self.between = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
        self.endless = [regex.compile(c) for c in (r"\p{L}+", r"\p{N}+", rf"[^{WHITE}\p{{L}}\p{{N}}]+")]
        self.white = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c))
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.entries = entries
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}
        self.next: dict[int, int] = {}  # a trie of the tokens' bytes: node and byte to node
        self.token = [-1]
        for b, i in vocab.items():
            node = 0
            for c in b:
                to = self.next.get(node << 8 | c)
                if to is None:
                    to = self.next[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i

    def _end(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens at a token's left (0) or right (1) end, from the whole to one byte: (token, rank that makes it, rank that uses it up)."""
        got = self.ends[side].get(token)
        if got is None:
            got, at, used = [], token, 1 << 40
            while at in self.parts:
                made = self.parts[at][0]
                got.append((at, made, used))
                at, used = self.parts[at][1 + side], made
            got.append((at, -1, used))
            self.ends[side][token] = got
        return got

    def _joins(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge of a rank below limit joins bytes of both tokens, were they side by side.

        Ends of the two that are there at the same time could merge. Such a merge comes first if its rank is lower than that
        of the merge which uses up the left end, and not higher than that of the one which uses up the right end (it begins
        further right, and equals go from left to right).
        """
        rank, left = self.rank.get, self._end(b, 0)
        for x, made_x, used_x in self._end(a, 1):
            for y, made_y, used_y in left:
                if made_y >= used_x:
                    continue  # not yet there
                if made_x >= used_y:
                    break  # no longer there, nor are its parts
                r = rank(x << 20 | y)
                if r is not None and r < limit and made_x < r < used_x and made_y < r <= used_y:
                    return True
        return False

    def _follows(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens side by side as they are."""
        if len(self.fits) >= 4 * self.entries:
            self.fits.clear()
        got = self.fits[a << 20 | b] = not self._joins(a, b, 1 << 40)
        return got

    def _stands(self, a: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        got = self.alone.get(a)
        if got is None:
            if a in self.parts:
                made, x, y = self.parts[a]
                got = self._stands(x) and self._stands(y) and not self._joins(x, y, made)
            else:
                got = len(self.bytes_of[a]) == 1
            self.alone[a] = got
        return got

    def _settle(self, data: bytes) -> list[int]:
        """The result of all merges of a bounded window: the one sequence of which any two neighbours stand side by side.

        Takes the longest token that may follow; goes back where none may. A place that failed once fails always, since
        the tokens before a place are settled by the bytes before it.
        """
        step, token, fits, n = self.next.get, self.token, self.fits.get, len(data)
        ids: list[int] = []
        at, before, limit, longest, dead = 0, -1, n, self.longest, set()
        while at < n:
            node, t, end = 0, -1, at
            for k, c in enumerate(data[at : min(limit, at + longest)], at + 1):
                node = step(node << 8 | c)
                if node is None:
                    break
                if token[node] >= 0:
                    t, end = token[node], k
            limit = n
            while t >= 0:
                if end not in dead:
                    ok = self._stands(t) if before < 0 else fits(before << 20 | t)
                    if ok is None:
                        ok = self._follows(before, t)
                    if ok:
                        break
                t = self._shorter(t)
                end = at + len(self.bytes_of[t]) if t >= 0 else at
            if t >= 0:
                ids.append(t)
                at, before = end, t
                continue
            dead.add(at)
            while True:  # the token before this place gets shorter
                k = len(self.bytes_of[ids.pop()])
                at, before = at - k, ids[-1] if ids else -1
                if k > 1:
                    limit = at + k - 1
                    break
                dead.add(at)
        return ids

    def _shorter(self, t: int) -> int:
        """The longest token that this one begins with, itself apart; -1: none."""
        got = self.prefix.get(t)
        if got is None:
            node, got, data = 0, -1, self.bytes_of[t]
            for c in data[:-1]:
                node = self.next[node << 8 | c]
                got = self.token[node] if self.token[node] >= 0 else got
            self.prefix[t] = got
        return got

    def stream(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one unit of the pattern that arrives in pieces of any size; emits what is stable, the rest at the unit's end."""
        held = b""
        for piece in pieces:
            for k in range(0, len(piece), self.window):
                held += piece[k : k + self.window]
                if len(held) < 2 * self.window:
                    continue
                done, stable, out = 0, len(held) - self.lookahead, self._settle(held)
                for n, i in enumerate(out):
                    if done + len(self.bytes_of[i]) > stable:
                        break
                    done += len(self.bytes_of[i])
                yield out[:n]
                held = held[done:]
        yield self._settle(held)

    def _kept(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= 64:
            if len(self.young) >= self.entries:
                self.old, self.young = self.young, {}
            self.young[text] = ids
        return ids

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Of one match of the pattern: what stream() gives, which for less than two windows is one part at the end."""
        data = unit.encode()
        ids = self._settle(data) if len(data) < 2 * self.window else [i for part in self.stream((data,)) for i in part]
        return self._kept(unit, tuple(ids))

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Of text between two places where the pattern can't join."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                if piece.isascii() and piece.removeprefix(" ").isalpha():
                    return self._unit(piece)  # one match of the pattern
                units = self.pattern.findall(piece)
                if len(units) == 1:
                    return self._unit(piece)
                got = tuple(i for unit in units for i in self.young.get(unit) or self.old.get(unit) or self._unit(unit))
            self._kept(piece, got)
        return got

    def _ordinary(self, text: str) -> list[int]:
        parts = self.between.split(text) if self.crowded.search(text) else text.split(" ")
        young, piece, out = self.young, self._piece, []
        for k, p in enumerate(parts):
            p = " " + p if k else p
            got = young.get(p)
            out += piece(p) if got is None else got
            if got is None:
                young = self.young
        return out

    def _part(self, text: str) -> list[int]:
        """Of text that no more text can change."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._ordinary(text) if text else []
        out: list[int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._ordinary(part)
        return out

    def _settled(self, held: str) -> int:
        """Up to where no more text can change the units: the last single space between two other characters, else the last unit after none."""
        at = len(held) - 1
        while (at := held.rfind(" ", 1, at)) > 0:
            if held[at - 1] not in self.white and held[at + 1] not in self.white:
                return at
        if len(held) < 2 * WINDOW or any(s[0] in held for s in self.special):
            return 0
        return max((m.start() for m in self.pattern.finditer(held) if m.start() and held[m.start() - 1] not in self.white), default=0)

    def encode_stream(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that arrives in pieces, as soon as they are settled.

        Holds a window of text. A unit without end is passed on to stream() as it comes; only white space without end, and
        such units with the first character of a special token, are held whole.
        """
        source, held = iter(pieces), ""
        for piece in source:
            held += piece
            cut = self._settled(held)
            if cut:
                yield self._part(held[:cut])
                held = held[cut:]
            run = next((c for c in self.endless if len(held) >= 2 * WINDOW and c.fullmatch(held, held[0] == " ") and not any(s[0] in held for s in self.special)), None)
            if run is not None:
                rest = [""]
                yield from self.stream(self._unit_without_end(held, source, run, rest))
                held = rest[0]
        if held:
            yield self._part(held)

    def _unit_without_end(self, held: str, source: Iterator[str], run, rest: list[str]) -> Iterator[bytes]:
        yield held.encode()
        for piece in source:
            m = run.match(piece)
            to = m.end() if m else 0
            if any(s[0] in piece[:to] for s in self.special):
                to = min(piece.find(s[0]) for s in self.special if s[0] in piece[:to])
            yield piece[:to].encode()
            if to < len(piece):
                rest[0] = piece[to:]
                return

    def encode(self, text: str) -> list[int]:
        if len(text) <= WINDOW:
            return self._part(text)
        return [i for part in self.encode_stream(windows(text)) for i in part]

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are whole; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.bytes_of.__getitem__
        for part in batched(ids, 8192):
            yield machine.decode(b"".join(map(of, part)))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


def windows(text: str) -> Iterator[str]:
    return (text[k : k + WINDOW] for k in range(0, len(text), WINDOW))


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


@contextmanager
def lent(path: str) -> Iterator[Transducer]:
    """A transducer for one task; what it has remembered goes when the task ends, since the process stays for others."""
    t = transducer(path)
    try:
        yield t
    finally:
        t.young, t.old = {}, {}
        t.fits.clear()


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would walk the caches again and again; the transducer makes no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id and the ids array of every row; null texts have none."""

    def run(batches):
        with lent(vocabulary) as t:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    part = b.slice(k, 64)
                    with uncollected():
                        ids = pa.array([t.encode(x.decode("utf-8", "replace")) for x in texts(column_of(part, text))], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([column_of(part, id), ids], names=[id, "ids"])

    return mapped(docs.select(id, text), run, T.StructType([docs.schema[id], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(tokens: DataFrame, vocabulary: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """id and the text of every row of ids; null ids give empty text."""

    def run(batches):
        t = transducer(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([column_of(b, id), pa.array([t.decode(x or []) for x in column_of(b, ids).to_pylist()], pa.string())], names=[id, "text"])

    return mapped(tokens.select(id, ids), run, T.StructType([tokens.schema[id], T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A round trip in one pass: the number of ids, and SHA-256 of the ids joined by commas and of the decoded text."""

    def run(batches):
        with lent(vocabulary) as t:
            for b in batches:
                n, ids_hex, text_hex = [], [], []
                for x in texts(column_of(b, text)):
                    count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                    machine = codecs.getincrementaldecoder("utf-8")("replace")
                    with uncollected():
                        for ids in t.encode_stream(windows(x.decode("utf-8", "replace"))):
                            if ids:
                                ids_hash.update(("," if count else "").encode() + ",".join(map(t.decimal.__getitem__, ids)).encode())
                                text_hash.update(machine.decode(b"".join(map(t.bytes_of.__getitem__, ids))).encode())
                                count += len(ids)
                    text_hash.update(machine.decode(b"", True).encode())
                    n.append(count)
                    ids_hex.append(ids_hash.hexdigest())
                    text_hex.append(text_hash.hexdigest())
                yield pa.RecordBatch.from_arrays([column_of(b, id), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(id, text), run, T.StructType([docs.schema[id], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
