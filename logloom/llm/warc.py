"""WARC as a PySpark data source, written and read.

Archives are gzip with one member a record; each member's header carries its own length (the
skip-length extra field of the WARC annex), so a reader inflates only a record's headers,
tests the pushed predicates on them and seeks over what it does not want, by ranged reads.
Filters on record_type, page_id, uri, payload_digest and refers_to are pushed down; `payload` is
decoded only when option payload is "true". A file is cut into partitions at the record offsets
that its writer left in the manifest, about SPLIT_BYTES each.

Other archives, .warc or .warc.gz without a manifest, are read too, one file a partition: plain
ones seek over unwanted records, compressed ones inflate them without keeping them. Headers they
lack are null; content and transfer encodings of their payloads stay as they are.

Writing: every task writes its own file into the shared folder and the driver's commit lists
the files in a manifest of its own, so lost, retried or speculative tasks leave nothing that is
read, and an append adds to what is there; mode overwrite deletes the older manifests.

Defined cases: null html is an empty payload; payloads under `MIN_REVISIT` bytes are always
responses; of equal longer payloads the rows with the largest page_id are responses, others
(null page_ids too) revisits; an empty table writes an archive without records; extra columns
are ignored; a record that ends too early is an error.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from logloom.llm.shared import shared_path, staged, table

MIN_REVISIT = 1000
#: Bytes of a partition, and of a ranged read: over headers alone, and over payloads.
SPLIT_BYTES, HEADER_STEP, PAYLOAD_STEP = 16 << 20, 64 << 10, 1 << 20
SCHEMA = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
PUSHED = {"page_id": "WARC-X-Page-ID", "uri": "WARC-Target-URI", "record_type": "WARC-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def clean(value: str) -> str:
    """Header values end at a line break."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, uri: str | None, kind: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    http = HTTP % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-X-Page-ID: {'' if page_id is None else page_id}"]
    lines += [] if uri is None else [f"WARC-Target-URI: {clean(uri)}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member whose extra field tells its compressed and plain length."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(raw))
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def headers_of(text: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in text.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)


class Ranges:
    """Reads at any place of a file through one window of `step` bytes or more."""

    def __init__(self, file, step: int):
        self.file, self.step, self.size, self.at, self.data = file, step, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes, or less at the end of the file."""
        n = min(n, self.size - at)
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read_at(min(max(n, self.step), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def own_records(ranges: Ranges, start: int, end: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and the payload of records that `wanted` accepts, of members that tell their length."""
    at = start
    while at < end:
        (size,) = struct.unpack("<I", ranges.read(at + 16, 4))
        z, text, place = zlib.decompressobj(-15), b"", at + 24
        while (cut := text.find(b"\r\n\r\n")) < 0:
            part = ranges.read(place, min(1024, at + size - 8 - place))
            if not part:
                raise ValueError(f"truncated record at byte {at}")
            place += len(part)
            text += z.decompress(part)
        head = headers_of(text[:cut])
        if wanted(head):
            body = None
            if payload and head["WARC-Type"] == "response":
                block = (text[cut + 4 :] + z.decompress(ranges.read(place, at + size - 8 - place)))[: int(head["Content-Length"])]
                body = block[block.find(b"\r\n\r\n") + 4 :]
            yield head, body
        at += size


class Plain:
    """The bytes of a file in order, inflated if they are gzip, of any number of members."""

    def __init__(self, ranges: Ranges):
        self.ranges, self.at, self.held = ranges, 0, b""
        self.packed = ranges.read(0, 2) == b"\x1f\x8b"
        self.z = zlib.decompressobj(31)

    def more(self) -> bool:
        """Adds bytes to `held`; False at the end."""
        part = self.ranges.read(self.at, self.ranges.step)
        self.at += len(part)
        if not self.packed:
            self.held += part
            return bool(part)
        while part:
            self.held += self.z.decompress(part)
            part = self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if self.held:
                self.at -= len(part)
                return True
            if not part:
                part = self.ranges.read(self.at, self.ranges.step)
                self.at += len(part)
        return False

    def take(self, n: int, keep: bool = True) -> bytes:
        out = [b""]
        while n > 0:
            if not self.held and not keep and not self.packed:
                self.at, n = self.at + n, 0
                break
            if not self.held and not self.more():
                raise ValueError("truncated record at the end of the file")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out)

    def head(self) -> bytes | None:
        """Up to an empty line; None at the end."""
        while (cut := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("truncated record at the end of the file")
                return None
        return self.take(cut + 4)[:-4]


def other_records(ranges: Ranges, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The same of any archive, from its first byte to its last."""
    stream = Plain(ranges)
    while (text := stream.head()) is not None:
        head = headers_of(text)
        n, body = int(head["Content-Length"]), None
        keep = payload and wanted(head) and head.get("WARC-Type") != "revisit"
        block = stream.take(n, keep)
        if keep:
            body = block[block.find(b"\r\n\r\n") + 4 :] if head.get("Content-Type", "").startswith("application/http") else block
        stream.take(4)
        if wanted(head):
            yield head, body


def page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"(?:<urn:page:)?(-?\d{1,19})>?", value or "")
    page = int(found[1]) if found else None
    return page if page is not None and -(1 << 63) <= page < 1 << 63 else None


def as_row(head: dict[str, str], body: bytes | None) -> tuple:
    digest, size = head.get("WARC-Payload-Digest"), head.get("WARC-X-Payload-Length")
    n = int(size) if size else None if body is None else len(body)
    return (page_of(head.get("WARC-X-Page-ID")), head.get("WARC-Target-URI"), head.get("WARC-Type"), digest and digest.removeprefix("sha1:"), n, page_of(head.get("WARC-Refers-To")), body)


@dataclass
class Archive(InputPartition):
    file: str
    start: int = 0
    end: int = -1  # -1: an archive of another writer, whole


@dataclass
class Written(WriterCommitMessage):
    file: str
    edges: list[int]


def manifests(where: fs.FileSystem, path: str) -> list[str]:
    return [x.path for x in where.get_file_info(fs.FileSelector(path)) if x.base_name.startswith(MANIFEST)]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "false").lower() == "true", []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, (EqualTo, In, IsNotNull)):
                self.tests.append((column, None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))
            yield f  # Spark applies them again, so a pushed test only has to be necessary

    def partitions(self):
        where, path = place(self.path)
        if where.get_file_info(path).type == fs.FileType.File:
            return [Archive(path)]
        found, parts = manifests(where, path), []
        for name in found:
            with where.open_input_stream(name) as f:
                for file, edges in json.loads(f.read()):
                    parts += [Archive(f"{path}/{file}", a, z) for a, z in pairwise(edges)]
        if not found:
            parts = [Archive(x.path) for x in where.get_file_info(fs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz"))]
        return sorted(parts, key=lambda p: (p.file, p.start)) or [Archive("")]

    def read(self, partition):
        if not partition.file:
            return
        where, _ = place(self.path)
        columns = {c: i for i, c in enumerate(x.split()[0] for x in SCHEMA.split(", "))}

        def wanted(head: dict[str, str]) -> bool:
            row = as_row(head, None)
            return all((v := row[columns[c]]) is not None and (allowed is None or v in allowed) for c, allowed in self.tests)

        with where.open_input_file(partition.file) as f:
            ranges = Ranges(f, PAYLOAD_STEP if self.payload and not self.tests or partition.end < 0 else HEADER_STEP)
            found = other_records(ranges, wanted, self.payload) if partition.end < 0 else own_records(ranges, partition.start, partition.end, wanted, self.payload)
            rows, size = [], 0
            for head, body in found:
                rows.append(as_row(head, body))
                size += len(body or b"") + 200
                if size > 4 << 20:
                    yield to_batch(rows)
                    rows, size = [], 0
            if rows:
                yield to_batch(rows)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        where, path = place(self.path)
        where.create_dir(path, recursive=True)
        name, edges, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with where.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in iterator:
                for page_id, uri, kind, digest, _, refers_to, payload in zip(*(b.column(c.split()[0]).to_pylist() for c in SCHEMA.split(", ")), strict=True):
                    raw = member(record(page_id, uri, kind, digest, payload or b"", refers_to))
                    out.write(raw)
                    at += len(raw)
                    if at - edges[-1] >= SPLIT_BYTES:
                        edges.append(at)
        return Written(name, edges + [at] * (at > edges[-1]))

    def commit(self, messages):
        where, path = place(self.path)
        where.create_dir(path, recursive=True)
        older = manifests(where, path) if self.overwrite else []
        with where.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([(m.file, m.edges) for m in messages if m is not None and len(m.edges) > 1]).encode())
        for found in older:
            where.delete_file(found)

    def abort(self, messages):
        pass


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Rows of SCHEMA: which record each page gets.

    Only ids and digests are shuffled to find the revisits. Their table is written, so the
    planner knows its size and broadcasts it, or shuffles the pages where it is too large.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    long = pages.filter(F.octet_length("html") >= MIN_REVISIT).select(F.col("page_id").cast("long").alias("page_id"), digest.alias("digest"))
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again = long.join(first, "digest").filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = staged(again.select(F.col("page_id").alias("_again"), F.col("digest").alias("_same"), F.col("first").alias("_first")), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), payload.alias("payload"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("payload_bytes"), digest.alias("payload_digest"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_again")) & (F.col("payload_digest") == F.col("_same")), "left")
    kind = F.when(F.col("_first").isNotNull(), "revisit").otherwise("response")
    return rows.select("page_id", "uri", kind.alias("record_type"), "payload_digest", "payload_bytes", F.col("_first").alias("refers_to"), "payload")


def write_warc(pages: DataFrame, path: str, *, mode: str = "append") -> None:
    register(pages.sparkSession)
    with_revisits(pages).write.format("warc").mode(mode).option("path", path).save()


def read_warc(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are judged by the payloads read back, revisits by their headers alone."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    full = read_warc(spark, path, payload=True).filter("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path).filter("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.unionByName(again)


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to FROM f
"""
