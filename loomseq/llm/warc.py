"""WARC archives as a chunked record table.

An archive is a table of rows (record, chunk, chunks, digest, data): the data of a record's rows, in order of chunk, are
its bytes in the WARC file format. No row holds more than CHUNK bytes of a payload, and each carries the SHA-1 of the
payload up to and with it, so a reader checks every row as it comes and never holds a record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 1 << 20
#: Digests (some 100 bytes each) that are broadcast at most; more are joined by an exchange of the payloads.
MOST_BROADCAST = 200_000
#: Field names and the profile of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "<urn:loomseq:page:{}>"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(page: int | None, url: str | None, date: str, first: int | None, size: int, sha1: bytes, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {NAME.format('' if page is None else page)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    lines.append(f"WARC-Payload-Digest: sha1:{digest32(sha1)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {NAME.format('' if first is None else first)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row and returns the archive table.

    Of records with equal payloads of at least `least_bytes` bytes, those with the smallest id are responses and the
    others revisit them. Null payloads are empty; null ids count as largest; a missing url is left out. Rows that repeat
    with one id are alike. An empty table makes an empty archive.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    # only payloads that occur twice have another record to refer to; digests and ids are few bytes, so payloads are read
    # twice and, if those digests are few enough to be broadcast, dealt out never
    # (a written table beside an exchange lets Spark split the rows of a payload that a large part of them share)
    again = rows.select("page_id", F.sha1("payload").alias("sha1")).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, "payloads")
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again.hint("merge")
    named = rows.withColumn("sha1", F.sha1("payload")).join(again, "sha1", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 40
        names = ["record", "chunk", "chunks", "digest", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        out, held = [], 0
        for batch in batches:
            for page, url, payload, first_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                view = memoryview(payload.as_buffer())
                size = len(view)
                revisit = size >= least_bytes and first_ is not None and page != first_
                n = 1 if revisit else max(1, -(-size // chunk))
                sha, whole = hashlib.sha1(), hashlib.sha1(view)
                for i in range(n):
                    part = b"" if revisit else bytes(view[i * chunk : (i + 1) * chunk])
                    sha.update(part)
                    data = (_header(page, url, date, first_, size, whole.digest(), revisit) if not i else b"") + part + (b"\r\n\r\n" if i == n - 1 else b"")
                    out.append((record, i, n, sha.hexdigest(), data))
                    held += len(data)
                    if held > 8 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                record += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "record long, chunk int, chunks int, digest string, data binary"
    return written(named.select("page_id", "url", "payload", "first").mapInArrow(run, schema), "archive")


class Reader:
    """One record from its chunks, in order."""

    def __init__(self, head: bytes):
        end = head.index(b"\r\n\r\n")
        lines = head[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        http_end = head.index(b"\r\n\r\n", end + 4) + 4
        self.http = {k.lower(): v for k, v in (x.split(": ", 1) for x in head[end + 4 : http_end - 4].decode().split("\r\n")[1:])}
        self.left = int(self.field["content-length"]) - (http_end - end - 4)
        self.size, self.sha, self.at = self.left, hashlib.sha1(), http_end
        self.revisit = self.field["warc-type"] == "revisit"

    def feed(self, data: bytes, digest: str) -> None:
        part = memoryview(data)[self.at :][: self.left]
        self.at, self.left = 0, self.left - len(part)
        self.sha.update(part)
        if self.sha.hexdigest() != digest:
            raise ValueError(f"damaged chunk of {self.field['warc-record-id']}")

    def row(self) -> tuple:
        page = lambda name: int(name[len(NAME) - 3 : -1]) if name and name[len(NAME) - 3 : -1] else None
        stored = self.field["warc-payload-digest"].removeprefix("sha1:")
        if self.left or not self.revisit and (digest32(self.sha.digest()) != stored or self.size != int(self.http["content-length"])):
            raise ValueError(f"damaged record {self.field['warc-record-id']}")
        return page(self.field["warc-record-id"]), int(self.http["content-length"]), stored, self.field["warc-type"], page(self.field.get("warc-refers-to"))


def read(archive: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; damaged records raise.

    Records of one row are read where they lie; the rows of larger ones meet in order of their chunk numbers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, kinds = None, None, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out = []
            for record, i, n, digest, data in zip(*(batch.column(j).to_pylist() for j in range(4)), batch.column(4), strict=True):
                raw = data.as_py()
                if i == 0:
                    reader, current = Reader(raw), (record, 0)
                elif (record, i - 1) != current:
                    raise ValueError(f"record {record} lacks chunk {i - 1}")
                else:
                    current = (record, i)
                reader.feed(raw, digest)
                if i == n - 1:
                    out.append(reader.row())
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    small = archive.where("chunks = 1").mapInArrow(run, schema)
    large = archive.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, schema)
    return small.unionByName(large)


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
