"""What the corpus operators share: the scratch folder, chunked Arrow input, hashes and a vectorised tokenizer."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a vectorised kernel takes at once; its arrays need about 40 times that.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; without one, a folder of the warehouse, which all executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/inkgrid/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder, where it stays until the driver ends, and reads it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    files, place = _files(df.sparkSession, path)
    files.deleteOnExit(place)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._inkgrid_path = path
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in Arrow batches of BATCH_BYTES; a size that the session sets itself stays.

    Spark's own limit, 64 MB, is held by each task several times over: in the JVM, in the pipe and in Python.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow() over small batches of texts, with the schema's columns by place.

    A worker process serves many tasks and stages: what a task has freed goes back to the system when it ends.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return small_batches(df).mapInArrow(run, schema)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def arrow_type(schema: T.StructType, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema[column].dataType)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing will read again."""
    path = getattr(df, "_inkgrid_path", None)
    if path:
        files, place = _files(df.sparkSession, path)
        files.delete(place, True)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()["b"] or 0


def utf8_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, one at a time; null is empty."""
    raw, offs = utf8_view(column)
    view = memoryview(raw)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield bytes(view[a:b])


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about limit bytes together; one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_PRIME = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo 2**31 - 1, for values below 2**62; the result may be the modulus itself for 0 only where x is not 0."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


class SoundHash:
    """Hashes of spans of up to 4 MiB + 1 KiB of data: polynomials at two secret points modulo 2**31 - 1.

    Two different spans of n bytes collide for at most n of 2**31 choices of each point, so for any data the chance is
    (n / 2**31)**2; the points are drawn at each run, so no data can be made to collide.
    """

    def __init__(self, points: tuple[int, int]):
        self.points, self.powers = points, []

    @staticmethod
    def draw() -> tuple[int, int]:
        import secrets

        return tuple(secrets.randbelow((1 << 31) - 1001) + 1000 for _ in range(2))

    def _tables(self, n: int) -> None:
        if self.powers and len(self.powers[0][0]) >= n:
            return
        self.powers = []
        for point in self.points:
            pair = []
            for base in (point, pow(point, -1, (1 << 31) - 1)):
                t = np.ones(1, np.uint64)
                while len(t) < n:
                    t = np.concatenate([t, _reduced(t * np.uint64(pow(base, len(t), (1 << 31) - 1)))])
                pair.append(t)
            self.powers.append(pair)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables(len(data) + 1)
        out = np.zeros(len(starts), np.uint64)
        for up, down in self.powers:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            out = out << np.uint64(31) | _reduced(_reduced(sums[ends] - sums[starts]) * down[starts])
        return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(62)))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums S with which span_hashes() hashes any span of data. Different spans can be made to collide: for choices, not for equality."""
    pw, _ = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], alike wherever the bytes stand."""
    _, inv = _powers(len(sums))
    h = (sums[ends] - sums[starts]) * inv[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each document the index of its first word (one more at the end)."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    inside[-1] = False
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.zeros(len(inside), bool)
    first[offsets] = True  # words end with their document
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that word_spans() found: XXH3 of each different word, which Arrow tells apart by its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.ascontiguousarray(data[~_SPACE[data]])  # words are all there is between white space
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w.as_buffer()) for w in words.dictionary], np.uint64)[words.indices.to_numpy()]


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence of words from that of all but the last; the last alone never makes two alike."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
