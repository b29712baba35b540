"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Writing: one gzip member per record, each archive with a warcinfo record first. Of records with
equal payloads of at least REVISIT_FROM bytes the one with the smallest page_id is a response
and the others are revisits that carry its digest, URI and date and their own HTTP header.
Which these are a shuffle of ids and digests tells; payloads stay in the scan, but for those of
pages that a bit table of bounded size marks as possible revisits.

Archives are written by Spark's own text sink, which passes bytes through, so any file system
that Spark writes to can hold them. A row of the sink is a run of members of CHUNK_BYTES, and a
fixed number of rows makes an archive, so archives are bounded in bytes. The sink ends each row
with one byte; that byte is NUL, and it is the last byte of the row's last member (the high
byte of its length, zero below 16 MiB; a longer member is kept whole and followed by a NUL,
which gzip readers skip as padding).

Reading: a task walks an archive from front to back, inflating a member a piece at a time,
frames the record by its Content-Length, and verifies block and payload digests while the
bytes pass, so that a task holds an archive's compressed bytes and one piece of a payload.

Defined results: null html is an empty payload; null url is written as URN; a null page_id is
larger than any other and read back as null; repeated rows are each written, under record ids
of their own, as responses if they share the smallest page_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle

REVISIT_FROM = 100
#: Bytes of members after which a row of the sink is full, and rows of an archive.
CHUNK_BYTES = 1 << 23
CHUNKS_IN_ARCHIVE = 8
#: Bits, as a power of two, of the table of possible revisits: at most 2^19 rows of 64 bits are broadcast.
TABLE_BITS = 25
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, verified boolean"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _record(kind: str, name: str, date: str, fields: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}"]
    head += [*fields, f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(page_id: int | None, url: str | None) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def record(place: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None, its_url: str | None = None, date: str = DATE) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit without. `place` tells it from records of the same page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields = [f"WARC-Target-URI: {_uri(page_id, url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_to, its_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"]
        return _record("revisit", f"page:{page_id}:{place}", date, fields, http)
    return _record("response", f"page:{page_id}:{place}", date, fields, http + (payload or b""))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members; every CHUNKS_IN_ARCHIVE-th begins an archive."""
    task = TaskContext.get()
    place = f"{task.partitionId() if task else 0}"
    chunk, chunks, records_written = bytearray(), 0, 0

    def row() -> pa.RecordBatch:
        # the row's end stands for a last byte that is NUL
        return pa.record_batch([pa.array([bytes(chunk[:-1] if chunk[-1] == 0 else chunk)], pa.binary())], names=["members"])

    for batch in batches:
        for page in batch.to_pylist():
            if not chunk and chunks % CHUNKS_IN_ARCHIVE == 0:
                about = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
                chunk += member(_record("warcinfo", f"archive:{place}:{chunks}", DATE, ["Content-Type: application/warc-fields"], about))
            chunk += member(record(f"{place}:{records_written}", page["page_id"], page["url"], page["body"], page["size"], page["digest"], page["refers_to"], page["its_url"]))
            records_written += 1
            if len(chunk) >= CHUNK_BYTES:
                yield row()
                chunk, chunks = bytearray(), chunks + 1
    if chunk:
        yield row()


#: Stands for a null page_id, which is larger than any other.
LAST_PAGE = (1 << 63) - 1


def _revisits(narrow: DataFrame) -> DataFrame:
    """The rows of page_id, url, size and digest that revisit another, with its id and URL."""
    equal = narrow.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("its_url"), F.count("*").alias("copies"))
    equal = equal.where("copies > 1 AND first_id IS NOT NULL").drop("copies")
    return narrow.join(equal, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "url", F.lit(None).cast("binary").alias("body"), "size", "digest", F.col("first_id").alias("refers_to"), "its_url")


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives in the folder path."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    revisits = settle(_revisits(settle(rows.drop("body"))))
    bit = F.xxhash64(F.coalesce("page_id", F.lit(LAST_PAGE)), "digest").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    table = revisits.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    marked = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(table), "word", "left")
    possible = F.coalesce(F.expr("shiftright(bits, cast(bit & 63 AS int)) & 1 = 1"), F.lit(False))
    keys = revisits.select(F.coalesce("page_id", F.lit(LAST_PAGE)).alias("key_id"), F.col("digest").alias("key_digest")).distinct()
    here = (F.coalesce("page_id", F.lit(LAST_PAGE)) == F.col("key_id")) & (F.col("digest") == F.col("key_digest"))
    plain = marked.where(~possible).unionByName(marked.where(possible).join(keys, here, "left_anti"))
    responses = plain.select("page_id", "url", "body", "size", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("its_url"))
    written = responses.unionByName(revisits).mapInArrow(_archives, "members binary").select(F.col("members").cast("string").alias("value"))
    written.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", CHUNKS_IN_ARCHIVE).text(path)


class _Inflater:
    """The bytes of one gzip member after the other, a piece at a time."""

    def __init__(self, archive: bytes):
        self.view, self.at = memoryview(archive), 0
        self.left = b""

    def nextmember(self) -> bool:
        while self.at < len(self.view) and self.view[self.at] == 0:  # padding
            self.at += 1
        self.inflate, self.left = zlib.decompressobj(31), b""
        return self.at < len(self.view)

    def piece(self) -> bytes:
        """Some more bytes of this member; empty at its end."""
        while not self.inflate.eof:
            if self.at >= len(self.view):
                raise EOFError("an archive ends within a member")
            fed = self.view[self.at : self.at + PIECE]
            out = self.inflate.decompress(fed, PIECE)
            self.at += len(fed) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes up to and with mark."""
        got = self.left
        while (end := got.find(mark)) < 0:
            more = self.piece()
            if not more:
                raise ValueError("a record ends within its header")
            got += more
        self.left = got[end + len(mark) :]
        return got[: end + len(mark)]

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            got = self.left or self.piece()
            if not got:
                raise ValueError("a record is shorter than its Content-Length")
            yield got[:n]
            self.left, n = got[n:], max(0, n - len(got))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def records(archive: bytes) -> Iterator[dict]:
    """The records of an archive, in order, with digests verified."""
    source = _Inflater(archive)
    while source.nextmember():
        head = _fields(source.until(b"\r\n\r\n"))
        about = head["warc-type"] == "warcinfo"
        length = int(head["content-length"])
        block_sha, payload_sha, payload_bytes, http = hashlib.sha256(), hashlib.sha256(), 0, None
        pending = b""
        for piece in source.exactly(length):
            block_sha.update(piece)
            if about:
                continue
            if http is None:
                pending += piece
                end = pending.find(b"\r\n\r\n")
                if end < 0:
                    continue
                http, piece = _fields(pending[: end + 2]), pending[end + 4 :]
            payload_sha.update(piece)
            payload_bytes += len(piece)
        if b"".join(source.exactly(4)) != b"\r\n\r\n" or source.left or source.piece():
            raise ValueError("a record isn't framed by its Content-Length")
        if about:
            if head["warc-block-digest"] != f"sha256:{block_sha.hexdigest()}":
                raise ValueError("a warcinfo record isn't what its digest says")
            continue
        revisit = head["warc-type"] == "revisit"
        said = head["warc-payload-digest"].removeprefix("sha256:")
        declared = int((http or {}).get("content-length", 0))
        yield {
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "payload_bytes": declared if revisit else payload_bytes,
            "payload_digest": said if revisit else payload_sha.hexdigest(),
            "record_type": head["warc-type"],
            "refers_to": int(head["x-refers-to-page-id"]) if revisit else None,
            "target_uri": head.get("warc-target-uri"),
            "verified": head["warc-block-digest"] == f"sha256:{block_sha.hexdigest()}" and (revisit or (said == payload_sha.hexdigest() and declared == payload_bytes)),
        }


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        for archive in batch.column("content"):
            rows = []
            for r in records(archive.as_py()):
                rows.append(r)
                if len(rows) == 5000:
                    yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in the folder path.

    Archives are dealt to tasks by size and each is read by one task.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, READ)
