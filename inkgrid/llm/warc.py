"""WARC archives with revisit resolution.

Headers (page, payload digest, size) are shuffled by digest; pages whose payload an earlier page has join its id and
become revisit records; archives are written with fresh headers and read back by Content-Length. A record is text
of headers and block, and Spark's text writer ends each with the two line breaks the format asks for, so any store
that Spark writes to can hold the archives. Each begins with a warcinfo record; their number follows the bytes of the payloads, about
``file_bytes`` each. The reader computes sizes and digests of responses from the payloads it reads and compares them with the headers;
a revisit's stand in its headers only.

Null html is an empty payload. Of equal payloads, all rows with the smallest page id are responses (a repeated row is
the same record again, with the same id); a null page id counts as larger than any other. Null URLs leave their header out. The pages of a
shared payload are dealt over ``salts`` keys, so the empty payload or a common one is no hot key. An empty table gives no record. Other
columns are not read, whatever their names. A payload over 2 GB can't be a value of the table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, mapped, materialise, scratch_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    min_revisit_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    file_bytes: int = 64 << 20
    salts: int = 32
    software: str = "inkgrid"


def headers(pages: DataFrame, html: str = "html", id: str = "page_id") -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(id).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def revisits(heads: DataFrame, params: WarcParams | None = None) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload another page holds."""
    p = params or WarcParams()
    heads = heads.where(F.col("size") >= p.min_revisit_bytes)
    shared = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max(F.col("page_id").isNull()).alias("_null"), F.max("page_id").alias("_last"))
    shared = materialise(shared.where((F.col("_last") > F.col("refers_to")) | (F.col("_null") & F.col("refers_to").isNotNull())).select("digest", "refers_to"), "originals")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    dealt = heads.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(p.salts)).cast("int").alias("salt"))
    found = dealt.join(salted, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def _field(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None, date: str) -> str:
    """A response, or a revisit if refers_to is given, without its closing line breaks."""
    name = "null" if page_id is None else str(page_id)
    size = len(payload.encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    block, length = (http + payload, len(http) + size) if refers_to is None else (http, len(http))
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}:{digest}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Target-URI: {_field(url)}"] if url else []), *([f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    return "\r\n".join(lines) + END + block


def info(p: WarcParams, number: int) -> str:
    block = f"software: {p.software}\r\nformat: WARC File Format 1.1\r\n"
    return "\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{number}>", f"WARC-Date: {p.date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]) + END + block


def write(pages: DataFrame, path: str, params: WarcParams | None = None, html: str = "html", url: str = "url", id: str = "page_id") -> None:
    """A record a page, in archives of about file_bytes of payload."""
    p = params or WarcParams()
    base = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    heads = materialise(headers(pages, html, id), "headers")
    n = max(1, -(-(heads.agg(F.sum("size").alias("b")).first()["b"] or 0) // p.file_bytes))
    # one shuffle, whatever the planner makes of joins: what a page refers to comes as a row just before the page's own
    rev = revisits(heads, p).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    both = base.withColumn("refers_to", F.lit(None).cast("long")).unionByName(rev)
    dealt = both.repartition(n, F.xxhash64("page_id", "digest")).sortWithinPartitions("page_id", "digest", F.col("html").isNotNull())

    def run(batches):
        from pyspark import TaskContext

        first, held, refers = [info(p, TaskContext.get().partitionId())], None, None
        for b in batches:
            out = []
            for i, u, d, r, h in zip(*(column_of(b, k).to_pylist() for k in ("page_id", "url", "digest", "refers_to")), column_of(b, "html")):
                if not h.is_valid:
                    held, refers = (i, d), r
                else:
                    out.append(record(i, u, h.as_py(), base64.b32encode(bytes.fromhex(d)).decode(), refers if held == (i, d) else None, p.date))
            yield pa.RecordBatch.from_arrays([pa.array(first + out if out else out, pa.string())], names=["value"])
            first = [] if out else first

    mapped(dealt.select("page_id", "url", "digest", "refers_to", "html"), run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


class Reader:
    """Records of a stream of bytes, by Content-Length; holds one record and a piece of input."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _fill(self, n: int) -> bool:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (at := self.held.find(b"\r\n\r\n")) < 0:
                if not self._fill(len(self.held) + 1):
                    if self.held.strip():
                        raise ValueError("an archive ends inside a record's headers")
                    return
            lines = self.held[:at].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            to = at + 4 + int(fields["content-length"])
            if not self._fill(to + 4):
                raise ValueError("an archive ends inside a record")
            yield fields, bytes(self.held[at + 4 : to])
            del self.held[: to + 4]


def _unzipped(data: bytes) -> Iterator[bytes]:
    """Of any number of gzip members, a piece at a time."""
    machine, view, at = zlib.decompressobj(31), memoryview(data), 0
    while at < len(view) or machine.unconsumed_tail:
        piece = machine.unconsumed_tail or view[at : (at := min(len(view), at + (1 << 16)))]
        got = machine.decompress(piece, 1 << 20)
        if got:
            yield got
        if machine.eof:
            rest = machine.unused_data
            machine = zlib.decompressobj(31)
            at -= len(rest)


def _page(name: str) -> int | None:
    v = name.strip("<>").split(":")[2]
    return None if v == "null" else int(v)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type and refers_to of every record."""

    def run(batches):
        for b in batches:
            for content in column_of(b, "content"):
                rows = []
                for fields, block in Reader(_unzipped(content.as_py())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        if size != len(payload):
                            raise ValueError("a payload is cut short")
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest:
                            raise ValueError("a payload doesn't have its digest")
                    refers = fields.get("warc-refers-to")
                    rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), payload.decode() if kind == "response" else None, size, digest, kind, _page(refers) if refers else None))
                    if len(rows) == 500:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return mapped(files.select("content"), run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, params: WarcParams | None = None, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, params, html, url, id)
    return read(pages.sparkSession, path)
