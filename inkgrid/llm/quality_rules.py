"""Quality rules: plain text counts and tokenizer fertility with rejection bands per language or script.

Fertility is measured with two public byte-level vocabularies, one made from mostly English text and one from many
languages: code points per token, the share of tokens that are no whole UTF-8 (byte fallback), and the entropy of the
document's tokens in bits. A document is rejected outside the bands of its language, or of its main script if the language has
no reference, under either vocabulary.

The bands come from references, one paragraph of ordinary prose a language (``PLAIN`` in the tests, which measure it
again): code points per token may be ``spread_low`` times fewer or ``spread_high`` times more than the paragraph's,
and the fallback share ``spread_share`` higher. Tokens' entropy must reach ``entropy_share`` of that of equally frequent
different tokens, as many as the document has, ``entropy_tokens`` at most; the paragraphs have 0.83 and more. Under ``sure_tokens``
tokens all bounds widen with the square root of the count, as the measures' errors do; no document goes unjudged.

Null texts are empty texts: all counts are 0 and base_failed is true (fewer than 10 words). Rows are judged one by one,
so repeated rows, ties and null ids give a row each; a null or unknown language is judged by script; empty tables give
empty tables. Texts over ``window`` characters are cut before spaces and encoded part by part. Other columns are not read by ``measured`` and pass
unchanged through ``kept_documents``, whatever their names.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chained, chunks, column_of, mapped, mix, utf8_view, word_hashes, word_spans

#: Measured on the references: code points per token and byte-fallback share under each vocabulary.
REFERENCES = {"en": ((5.193, 0.0), (5.148, 0.0)), "de": ((2.695, 0.021), (4.031, 0.0)), "fr": ((3.006, 0.012), (3.924, 0.0)), "es": ((2.868, 0.011), (4.024, 0.0))}
#: Lowest and highest code points per token and highest byte-fallback share of scripts without a reference: from one
#: token a byte, the worst a byte-level vocabulary can do to the script, to twice what Latin prose reaches.
SCRIPT_BANDS = {"latin": (0.9, 10.0, 0.35), "cyrillic": (0.5, 5.0, 1.0), "greek": (0.5, 5.0, 1.0), "hebrew": (0.4, 5.0, 1.0), "arabic": (0.4, 5.0, 1.0), "cjk": (0.25, 3.0, 1.0), "other": (0.2, 10.0, 1.0)}
#: First code point of each script's main blocks.
SCRIPT_STARTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0xFF00, "cjk"), (0xFFF0, "other"), (0x20000, "cjk"), (0x32000, "other")]


@dataclass(frozen=True)
class QualityParams:
    vocabularies: tuple[str, ...] = ()  # paths of files of base64 ranks; empty: the two byte-level ones of public_tokenizers
    spread_low: float = 2.75
    spread_high: float = 2.0
    spread_share: float = 0.25
    entropy_share: float = 0.7
    entropy_tokens: int = 315
    sure_tokens: int = 64
    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    window: int = 1 << 16
    references: dict = field(default_factory=lambda: REFERENCES)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_NAMES = [b for _, b in SCRIPT_STARTS]


class Fertility:
    """Token ids of whole texts under every vocabulary."""

    def __init__(self, paths: tuple[str, ...], window: int):
        import public_tokenizers
        import tiktoken

        self.encode, self.partial, self.window = [], [], window
        for path in paths or [public_tokenizers.path(f"byte_bpe_{k}50k.tiktoken") for k in ("", "multi_")]:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode.append(tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
            partial = np.zeros(max(ranks.values()) + 1, bool)
            for b, i in ranks.items():
                try:
                    b.decode()
                except UnicodeDecodeError:
                    partial[i] = True
            self.partial.append(partial)

    def ids(self, text: str) -> list[np.ndarray]:
        """Texts beyond the window are cut before spaces (where there is none, at the window), and the parts encoded one by one."""
        parts, at = [], 0
        while len(text) - at > self.window:
            to = text.rfind(" ", at + 1, at + self.window)
            to = to if to > 0 else at + self.window
            parts.append(text[at:to])
            at = to
        parts.append(text[at:] if at else text)
        return [np.concatenate([np.array(e(x), np.int32) for x in parts]) for e in self.encode]

    def measure(self, text: str) -> list[tuple[int, float, float]]:
        """Tokens, fallback share and entropy under each vocabulary."""
        if not text:
            return [(0, 0.0, 0.0)] * len(self.encode)
        out = []
        for ids, partial in zip(self.ids(text), self.partial):
            n = len(ids)
            counts = np.unique(ids, return_counts=True)[1] if n < 4096 else np.bincount(ids)
            p = counts[counts > 0] / n
            out.append((n, float(partial[ids].mean()), float(-(p * np.log2(p)).sum())))
        return out


def main_script(text: str) -> str:
    """The script with most letters; ties go to the first in alphabetical order."""
    if text.isascii():
        return "latin"
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = cp[(cp > 64) & ~((cp >= 91) & (cp <= 96)) & ~((cp >= 123) & (cp <= 191))]
    if not len(cp):
        return "latin"
    counts = np.bincount(np.searchsorted(_STARTS, cp, "right") - 1, minlength=len(_NAMES))
    by: dict[str, int] = {}
    for name, c in zip(_NAMES, counts.tolist()):
        by[name] = by.get(name, 0) + c
    return min(by, key=lambda k: (-by[k], k))


def within_bands(p: QualityParams, lang: str | None, text: str, measures: list[tuple[int, float, float]]) -> bool:
    """Whether a text that has tokens lies in the bands under every vocabulary."""
    known = p.references.get(lang or "")
    script = None if known else SCRIPT_BANDS[main_script(text)]
    for k, (n, share, entropy) in enumerate(measures):
        loose = max(1.0, math.sqrt(p.sure_tokens / n))
        low, high, most = (known[k][0] / p.spread_low, known[k][0] * p.spread_high, known[k][1] + p.spread_share) if known else script
        floor = p.entropy_share * min(math.log2(n), math.log2(p.entropy_tokens))
        if not (low / loose <= len(text) / n <= high * loose and share <= most * loose and entropy >= floor / loose):
            return False
    return True


def _repeats(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: its words, and those inside windows of k words that occur again in it."""
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    n = len(starts)
    if n < k:
        return n_words, np.zeros(len(n_words), np.int64)
    h = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    win = h[: n - k + 1].copy()
    for j in range(1, k):
        win = chained(win, h[j : n - k + 1 + j])
    own = doc[: n - k + 1] == doc[k - 1 :]
    win = mix(win ^ mix(doc[: n - k + 1].astype(np.uint64) + np.uint64(1)))[own]
    at = np.flatnonzero(own)
    order = np.argsort(win, kind="stable")
    same = np.zeros(len(win) + 1, bool)
    same[1:-1] = win[order][1:] == win[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + k, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return n_words, sums[first[1:]] - sums[first[:-1]]


def base_counts(data: np.ndarray, offs: np.ndarray, p: QualityParams) -> dict[str, np.ndarray]:
    at = lambda flags: (s := np.concatenate([[0], np.cumsum(flags)]))[offs[1:]] - s[offs[:-1]]
    n_words, repeat = _repeats(data, offs, p.repeat_window)
    dup = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        lines = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out = {"n_words": n_words, "word_chars": at(((data & 0xC0) != 0x80) & ~_WS[data]), "n_symbols": at(_SYMBOL[data]), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat}
    return {k: v.astype(np.int64) for k, v in out.items()}


_PLAIN = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean")]
_EACH = [("n_tokens", "long"), ("chars_per_token", "double"), ("fallback_share", "double"), ("token_entropy", "double")]
_FERTILITY: dict[tuple, Fertility] = {}


def measures(p: QualityParams) -> list[tuple[str, str]]:
    """Names and types of what is measured; the second vocabulary's columns end in _2, and so on."""
    return [*_PLAIN, *((name + (f"_{k + 1}" if k else ""), kind) for k in range(len(p.vocabularies) or 2) for name, kind in _EACH)]


def _measure(p: QualityParams, raw: np.ndarray, offs: np.ndarray, langs: list[str | None]) -> list[list]:
    key = (p.vocabularies, p.window)
    if key not in _FERTILITY:
        _FERTILITY[key] = Fertility(*key)
    fert, names = _FERTILITY[key], [k for k, _ in measures(p)]
    out: list[list] = [[] for _ in names]
    for i, j in chunks(offs):
        data, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        counts = base_counts(data, own, p)
        for k, (name, _) in enumerate(_PLAIN[:5]):
            out[k] += counts[name].tolist()
        for d, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist())):
            text = data[a:b].tobytes().decode("utf-8", "replace")
            n = int(counts["n_words"][d])
            failed = n < p.min_words or 100 * int(counts["n_repeat_words"][d]) > p.max_repeat_percent * n
            got = fert.measure(text)
            row = [failed, not failed and within_bands(p, langs[i + d], text, got)]
            for tokens, share, entropy in got:
                row += [tokens, len(text) / tokens if tokens else 0.0, share, entropy]
            for column, value in zip(out[5:], row):
                column.append(value)
    return out


def measured(docs: DataFrame, params: QualityParams | None = None, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) of each document and what the rules measure on its whole text."""
    p, keep = params or QualityParams(), keep or ["doc_id"]
    has = lang in docs.columns
    used = docs.select(*dict.fromkeys([*keep, text, *([lang] if has else [])]))
    spark_kinds, kinds = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    own = measures(p)

    def run(batches):
        for b in batches:
            raw, offs = utf8_view(column_of(b, text))
            got = _measure(p, raw, offs, column_of(b, lang).to_pylist() if has else [None] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keep), *(pa.array(v, kinds[t]) for v, (_, t) in zip(got, own))], names=[*keep, *(k for k, _ in own)])

    return mapped(used, run, T.StructType([docs.schema[k] for k in keep] + [T.StructField(k, spark_kinds[t]) for k, t in own]))


def kept_documents(docs: DataFrame, params: QualityParams | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns; one pass without a shuffle."""
    p, columns = params or QualityParams(), docs.columns
    has, at = lang in columns, [k for k, _ in measures(params or QualityParams())].index("kept")

    def run(batches):
        for b in batches:
            raw, offs = utf8_view(column_of(b, text))
            got = _measure(p, raw, offs, column_of(b, lang).to_pylist() if has else [None] * b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, names=columns).filter(pa.array(got[at], pa.bool_()))

    return mapped(docs, run, docs.schema)
