"""WARC archives as a Python data source.

Writing: each task writes one archive of records (WARC/1.1, one gzip member each, whose extra field ``sl`` gives the
compressed and the raw length, as the format's annex proposes) under an own name; the commit publishes the names, sizes
and split points of the successful tasks in a manifest, so files of lost or repeated attempts are never read.

Reading: the manifest is planned into partitions of about ``SPLIT_BYTES`` at record starts. Filters on record type and
on header columns are taken over by the reader; a record's headers are decompressed first, and a record that fails
them, or whose payload nobody asks for (option ``payload=false``), is skipped by its length without being decoded.

:func:`archive` decides what is a revisit: of equal payloads (SHA-1 and length) of at least ``min_bytes``, the row of
the largest ``page_id`` is the response, the others refer to it.

Defined cases: a null or empty html is an empty payload; a null ``page_id`` or ``url`` is left out of the headers and
counts as the smallest id; rows that share the largest id of a payload are responses each; an empty table writes an
empty archive; other columns are dropped. A record is held in memory whole, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from ..session import shared_path
from .common import or_empty

SPLIT_BYTES = 8 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)
HEADER_COLUMNS = ("record_type", "target_uri", "page_id", "refers_to", "payload_digest")


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Any store that Arrow knows (file, hdfs, s3, gs)."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------------------ records


def member(head: bytes, body: bytes) -> bytes:
    """One gzip member, its two lengths in the extra field."""
    raw = head + body
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    deflated = pack.compress(raw) + pack.flush()
    size = 10 + 2 + 12 + len(deflated) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + deflated + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(row) -> bytes:
    payload = bytes(row["payload"]) if row["refers_to"] is None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + " ".join(row["target_uri"].split()))
    if row["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head.append(f"Content-Length: {len(block)}")
    return member(("\r\n".join(head) + "\r\n\r\n").encode(), block + b"\r\n\r\n")


class RecordStream:
    """Records of a file from ``start`` up to ``stop``: headers first, the block only on demand."""

    def __init__(self, file: pa.NativeFile, start: int, stop: int):
        self.file, self.at, self.stop = file, start, stop

    def __iter__(self) -> Iterator[dict[str, str]]:
        while self.at < self.stop:
            self.file.seek(self.at)
            fixed = self.file.read(24)
            if fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:14] != b"sl":
                raise ValueError(f"no record at byte {self.at}")
            self.size, self.raw = struct.unpack("<II", fixed[16:24])
            self.inflate, self.left, self.head = zlib.decompressobj(-15), self.size - 32, b""
            while (end := self.head.find(b"\r\n\r\n")) < 0:
                self.head += self._more(1 << 12)
            head, self.head = self.head[:end], self.head[end + 4 :]
            self.at += self.size
            lines = head.decode().split("\r\n")
            yield dict(x.split(": ", 1) for x in lines[1:])

    def _more(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        if not got:
            raise ValueError("a record ends early")
        self.left -= len(got)
        return self.inflate.decompress(got)

    def block(self) -> bytes:
        parts = [self.head]
        while self.left:
            parts.append(self._more(1 << 20))
        return b"".join([*parts, self.inflate.flush()])[:-4]


# ------------------------------------------------------------------------------ the data source


class Written(WriterCommitMessage):
    def __init__(self, name: str, size: int, splits: list[int], rows: int):
        self.name, self.size, self.splits, self.rows = name, size, splits, rows


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        fs, root = filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        fs.create_dir(root, recursive=True)
        at, rows, splits = 0, 0, [0]
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                data = record(row)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                out.write(data)
                at, rows = at + len(data), rows + 1
        return Written(name, at, splits, rows)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.rows]
        with fs.open_output_stream(f"{root}/_manifest.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Without a manifest nothing of the folder is read."""


class Span(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        super().__init__((name, start, stop))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((f.attribute[0], (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((f.attribute[0], tuple(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] == "record_type":
                pass  # every record has one
            else:
                yield f

    def partitions(self) -> list[Span]:
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/_manifest.json", compression=None) as f:
            files = json.loads(f.read())
        return [Span(x["name"], a, b) for x in files for a, b in zip(x["splits"], [*x["splits"][1:], x["size"]], strict=True)] or [Span("", 0, 0)]

    def read(self, partition: Span):
        name, start, stop = partition.value
        if stop <= start:
            return
        fs, root = filesystem(self.path)
        with fs.open_input_file(f"{root}/{name}") as f:
            records = RecordStream(f, start, stop)
            for h in records:
                row = {
                    "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"], "target_uri": h.get("WARC-Target-URI"), "page_id": int(h["X-Page-ID"]) if "X-Page-ID" in h else None,
                    "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
                    "refers_to": int(h["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in h else None, "payload": None,
                }
                if any(row[c] not in values for c, values in self.tests):
                    continue
                if self.payload and row["refers_to"] is None:
                    payload = records.block().split(b"\r\n\r\n", 1)[1]
                    if len(payload) != row["payload_bytes"] or base32_sha1(payload) != row["payload_digest"]:
                        raise ValueError(f"payload of {row['record_id']} does not match its digest")
                    row["payload"] = payload
                yield tuple(row.values())


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write a record for each row of ``pages``; the folder's path."""
    register(pages.sparkSession)
    p = pages.select("page_id", F.col("url").alias("target_uri"), or_empty("html").cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("sha", F.unhex(F.sha1("payload")))
    same = p.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c"))
    kept = same.filter("c > 1").drop("c")
    both = p.join(kept, ["sha", "payload_bytes"], "left").withColumn("refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")))
    both = both.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    rows = both.select(
        F.lit(None).cast("string").alias("record_id"), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri", "page_id", "payload_bytes",
        _base32("sha").alias("payload_digest"), "refers_to", "payload",
    )
    path = shared_path(pages.sparkSession, "warc")
    rows.write.format("warc").mode("append").save(path)
    return path


def _base32(col: str):
    """RFC 4648 text of 20 bytes, five bits a letter."""
    digits = F.hex(col)
    bits = F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 2), 20, "0") for k in range(8)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)])


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)



ORACLE = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
k AS (SELECT n, h, max(page_id) AS keeper FROM p GROUP BY 1, 2)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS NOT DISTINCT FROM k.keeper THEN NULL ELSE k.keeper END AS refers_to
FROM p JOIN k USING (n, h)
"""
