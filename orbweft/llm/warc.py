"""WARC archives: writing, and a normaliser for archives that are one gzip stream.

An archive compressed as a whole can only be read from its start. The normaliser inflates the stream once, chunk by
chunk, rewrites every record as a gzip member of its own and writes a sidecar index of offsets, after which any record
is one seek away. Records of any type pass as they are, byte for byte: their version, the order, spelling and repeats
of their headers, and their block. Archives are bounded in size, so each is a task's work and a lost task is done again.

Defined results: null html is the empty payload; rows of equal payload and equal smallest page_id are all responses;
a null page_id is never smaller than another; urls are percent-encoded where a header could not carry them, null is
empty; an empty table gives an empty result. A record that is cut off by the end of its archive, does not begin with a
version or has no length raises ValueError. Payloads are equal by SHA-256.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweft.llm.dedup import sent
from orbweft.llm.files import open_fs, publish
from orbweft.session import folder, stored, table

#: Payload bytes after which a task begins another archive; bytes inflated at a time; compression level.
ARCHIVE, STEP, LEVEL = 64 << 20, 1 << 20, 4
DATE = "2020-01-01T00:00:00Z"


@dataclass
class Record:
    """head: the record's lines from its version on, without the blank line that ends them."""

    head: bytes
    payload: bytes

    @classmethod
    def made(cls, headers: dict[str, str], payload: bytes, version: str = "WARC/1.1") -> Record:
        lines = [version, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}"]
        return cls("\r\n".join(lines).encode(), payload)

    def encode(self) -> bytes:
        return self.head + b"\r\n\r\n" + self.payload + b"\r\n\r\n"

    @property
    def version(self) -> str:
        return self.head.split(b"\r\n", 1)[0].decode("latin-1")

    @property
    def headers(self) -> list[tuple[str, str]]:
        """Names as they are spelled, and values; a line that begins with a space goes on with the one before."""
        lines = re.sub(b"\r\n[ \t]+", b" ", self.head).split(b"\r\n")[1:]
        pairs = [x.decode("utf-8", "surrogateescape").partition(":") for x in lines]
        return [(k.strip(), v.strip()) for k, _, v in pairs]

    def get(self, name: str) -> str | None:
        """The first value of a header, whatever the case of its name."""
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> Record:
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to is None:
        return Record.made(headers, html)
    more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Payload-Length": str(len(html))}
    return Record.made(headers | more, b"")


class Parser:
    """Records of a byte stream that arrives in pieces; holds one record at most."""

    def __init__(self):
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[Record]:
        self.buffer += data
        at = 0
        while True:
            end = self.buffer.find(b"\r\n\r\n", at)
            if end < 0:
                break
            record = Record(bytes(self.buffer[at:end]), b"")
            if not record.head.startswith(b"WARC/"):
                raise ValueError("a record does not begin with its version")
            size = record.get("Content-Length")
            if size is None or not size.isdecimal():
                raise ValueError("a record has no length")
            last = end + 4 + int(size)
            if len(self.buffer) < last + 4:
                break
            if self.buffer[last : last + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            record.payload = bytes(self.buffer[end + 4 : last])
            yield record
            at = last + 4
        del self.buffer[:at]

    def end(self) -> None:
        if self.buffer:
            raise ValueError("the archive ends within a record")


def gzip_whole(records: Iterable[Record], out) -> None:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for r in records:
        out.write(squeeze.compress(r.encode()))
    out.write(squeeze.flush())


def inflate(source, step: int = STEP) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its number of members, in pieces of at most step bytes."""
    machine = zlib.decompressobj(31)
    begun = False
    while data := source.read(step):
        while data:
            piece = machine.decompress(data, step)
            begun = True
            if piece:
                yield piece
            if machine.eof:
                data, machine, begun = machine.unused_data, zlib.decompressobj(31), False
            else:
                data = machine.unconsumed_tail
    if begun:
        while piece := machine.decompress(machine.unconsumed_tail, step):
            yield piece
        if not machine.eof:
            raise ValueError("the archive ends within its compressed stream")


def records(source, step: int = STEP) -> Iterator[Record]:
    parser = Parser()
    for data in inflate(source, step):
        yield from parser.feed(data)
    parser.end()


#: What the index tells of a record; null where it lacks the header.
INDEXED = {"id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest"}


def normalise(source, out) -> Iterator[dict]:
    """Rewrite every record of source as its own member of out; yields the lines of the index."""
    at = 0
    for r in records(source):
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = squeeze.compress(r.encode()) + squeeze.flush()
        out.write(member)
        yield {**{k: r.get(n) for k, n in INDEXED.items()}, "offset": at, "length": len(member)}
        at += len(member)


def read_at(source, offset: int, length: int) -> Record:
    source.seek(offset)
    parser = Parser()
    (record,) = parser.feed(zlib.decompress(source.read(length), 31))
    parser.end()
    return record


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of at least min_bytes all but the smallest page_id refer to it."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(sent(stored(groups.where("n > 1").select("digest", "first"), "copies")), "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_whole(rows: DataFrame, place: str) -> DataFrame:
    """Archives of rows, each one gzip stream of bounded size; their paths."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        pending: list[Record] = []
        size = 0

        def flush():
            nonlocal pending, size, k
            uri = publish(f"{place}/whole/part-{part:06d}-{k:04d}.warc.gz", lambda out: gzip_whole(pending, out))
            pending, size, k = [], 0, k + 1
            return pa.RecordBatch.from_pydict({"path": [uri]})

        for b in batches:
            for page_id, url, html, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
                pending.append(page_record(page_id, url, html, digest, ref))
                size += len(html) + 512
                if size >= ARCHIVE:
                    yield flush()
        if pending:
            yield flush()

    return rows.mapInArrow(run, "path string")


def normalised(paths: DataFrame, place: str) -> DataFrame:
    """Each archive rewritten with a member a record and its index beside it: path, index, records."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                name = path.rsplit("/", 1)[1]
                lines: list[str] = []

                def members(out, fs=fs, at=at, lines=lines):
                    with fs.open_input_stream(at, compression=None) as source:
                        lines += [json.dumps(x) for x in normalise(source, out)]

                uri = publish(f"{place}/members/{name}", members)
                index = publish(f"{place}/members/{name}.index", lambda out, lines=lines: out.write("".join(x + "\n" for x in lines).encode()))
                yield pa.RecordBatch.from_pydict({"path": [uri], "index": [index], "records": [len(lines)]})

    return paths.mapInArrow(run, "path string, index string, records long")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


ARROW = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in map(str.split, SCHEMA.split(", "))])


def read_members(archives: DataFrame) -> DataFrame:
    """A row for each record of archives of pages, read through the index."""
    number = re.compile(r"<urn:page:(-?\d+)>")

    def page(text: str | None) -> int | None:
        return int(m[1]) if text and (m := number.fullmatch(text)) else None

    def run(batches):
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_stream(open_fs(index)[1], compression=None) as f:
                    lines = [json.loads(x) for x in f.read().decode().splitlines()]
                out = []
                with fs.open_input_file(at) as source:
                    for x in lines:
                        r = read_at(source, x["offset"], x["length"])
                        h = {k.lower(): v for k, v in r.headers}
                        full = h["warc-type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(r.payload).digest()).decode() if full else h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                        out.append({"page_id": page(h["warc-record-id"]), "payload_bytes": len(r.payload) if full else int(h["warc-payload-length"]), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": page(h.get("warc-refers-to"))})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return archives.select("path", "index").mapInArrow(run, SCHEMA)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages, normalise the archives and give what they hold: path, index and records of each archive."""
    spark = pages.sparkSession
    place = folder(spark, "warc")
    whole = stored(write_whole(with_references(pages, min_bytes), place), "whole")
    return stored(normalised(spread(whole), place), "members")


def spread(paths: DataFrame) -> DataFrame:
    """Archives dealt one by one, as each is a task's work."""
    return paths.repartition(min(max(paths.count(), 1), 10_000))


def op10_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives of one stream, normalised and read back through the index."""
    return read_members(spread(archived(table(spark, sf_dir, "pages"))))


OP10_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM t),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)) AS parts FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
