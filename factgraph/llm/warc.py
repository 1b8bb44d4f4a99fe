"""WARC archives: records written by tasks, and a sequential reader.

Every page becomes one record in a gzip member of its own.  Of pages with
equal payloads of at least 1000 bytes the one with the largest ``page_id`` is
written as a response, the others as revisits of it without the payload.

The reader goes through an archive once in blocks of 256 KB: each member is
decompressed step by step by zlib, the record is framed by its Content-Length,
and digests of block and payload are taken on the way, so a record of any size
needs the memory of one block.  A wrong digest, length or header raises.

Archives lie in the shared folder and are named by the job, task and attempt
that wrote them; only those of attempts that Spark accepted are listed and
read.

Nulls: a null html is an empty payload, a null url an empty target; a null
``page_id`` is kept as null, never is the one referred to when another page
has the same payload, and is a response when all such pages are null.  Pages
with the same id and payload as the one referred to are responses too.  An
empty table writes no archive.  Other columns are not read.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch

LEAST_SHARED = 1000
LEVEL = 6
READ = 256 << 10


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _id(page_id: int | None) -> str:
    return "<urn:page:" + ("" if page_id is None else str(page_id)) + ">"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One compressed record."""
    digest = hashlib.sha1(payload).digest()
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if is_revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", _id(page_id)),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", _b32(digest)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        fields += [("WARC-Refers-To", _id(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


class Members:
    """The decompressed bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate, self.ready = stream, b"", None, b""

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(READ)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.rest)

    def some(self) -> bytes:
        """The next bytes of this member; none at its end."""
        while not self.ready and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.stream.read(READ)
            if not data:
                raise ValueError("archive ends within a member")
            if not self.inflate.unconsumed_tail:
                self.rest = b""
            self.ready = self.inflate.decompress(data, READ)
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
        out, self.ready = self.ready, b""
        return out

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``, in any length; the member's end bounds them."""
        found, at = bytearray(), -1
        while at < 0:
            more = self.some()
            if not more:
                raise ValueError("record header without an end")
            seen = max(len(found) - len(mark) + 1, 0)
            found += more
            at = found.find(mark, seen)
        at += len(mark)
        self.ready = bytes(found[at:]) + self.ready
        return bytes(found[:at])

    def upto(self, n: int) -> bytes:
        """At most ``n`` bytes; none at the member's end."""
        data = self.some() if n else b""
        self.ready = data[n:] + self.ready
        return data[:n]


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode().split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(stream) -> Iterator[dict]:
    """Headers and verified payload sizes and digests of an archive, in order."""
    members = Members(stream)
    while members.next_member():
        raw = members.until(b"\r\n\r\n")
        if not raw.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        warc = _headers(raw)
        left = int(warc["content-length"])
        block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
        http = members.until(b"\r\n\r\n")
        block.update(http)
        left -= len(http)
        declared = int(_headers(http)["content-length"])
        while left > 0:
            data = members.upto(left)
            if not data:
                raise ValueError("record is shorter than its Content-Length")
            block.update(data)
            payload.update(data)
            size += len(data)
            left -= len(data)
        tail = b""
        while more := members.some():
            tail += more
            if len(tail) > 4:
                break
        if left or tail != b"\r\n\r\n":
            raise ValueError("record does not end at its Content-Length")
        if warc["warc-block-digest"] != _b32(block.digest()):
            raise ValueError(f"block digest differs in {warc['warc-record-id']}")
        stated = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:"))
        if warc["warc-type"] == "response" and (size != declared or stated != payload.digest()):
            raise ValueError(f"payload digest differs in {warc['warc-record-id']}")

        def page(name):
            number = warc.get(name, "")[len("<urn:page:"):-1]
            return int(number) if number else None

        yield {"page_id": page("warc-record-id"), "url": warc["warc-target-uri"], "payload_bytes": declared,
               "payload_digest": stated.hex(), "record_type": warc["warc-type"], "refers_to": page("warc-refers-to")}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store = out = None
        records = size = 0
        for batch in batches:
            if out is None:
                store, inner = fs.FileSystem.from_uri(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(inner, compression=None)
            for page_id, url, html, refers_to, revisit in zip(*batch.columns):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data = record(page_id.as_py(), url.as_py() or "", payload, refers_to.as_py(), revisit.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, inner = fs.FileSystem.from_uri(path)
            rows, total = [], 0
            with store.open_input_stream(inner, compression=None) as stream:
                for row in read_records(stream):
                    rows.append(row)
                    total += 1
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows = []
            if total != stated:
                raise ValueError(f"{path} has {total} records, {stated} were written")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, digest, refers_to): the pages that another page of equal payload stands for."""
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode("html", "UTF-8").alias("payload"))
    keys = keys.where(F.octet_length("payload") >= LEAST_SHARED).select("page_id", F.sha1("payload").alias("digest"))
    keys = scratch.keep(keys.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")), "digests")
    shared = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1")
    # both sides are written and nothing is grouped by digest after, so Spark can split a payload that very many pages have
    found = keys.drop("n").join(scratch.keep(shared.drop("n"), "shared"), "digest")
    return scratch.keep(found.where("refers_to is not null and not page_id <=> refers_to"), "revisits")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives of all pages; returns path, records and bytes of each."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or f"{scratch.folder}/archives-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode("html", "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_SHARED, F.sha1("payload")).otherwise(""))
    other = revisits(pages, scratch).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    rows = rows.join(other, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", "payload", "refers_to", F.col("__digest").isNotNull().alias("revisit"))
    return scratch.keep(rows.mapInArrow(_writer(folder), "path string, records bigint, bytes bigint"), "list")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the listed archives; an archive is read by one task."""
    paths = archives.select("path", "records")
    paths = paths.repartition(max(1, min(archives.count(), 10_000)), "path")
    return paths.mapInArrow(_read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                                   "record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages))
