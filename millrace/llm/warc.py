"""WARC archives as a table of chunks.

A record's payload is never held whole: it is a run of rows (record, chunk number, bytes), in the
order of the chunks and next to each other, each with the SHA-1 of the payload up to its end. The
writer takes such rows and compresses them, one gzip member a record, as they come; the reader takes
members apart in the same way. Writing also leaves a table of segments, ranges of an archive that
begin and end with a record, so that any number of tasks read an archive by its bytes; a file that
the table doesn't name, such as a lost task's, is not read.

Payloads that several records share are stored once: the one with the largest id is a ``response``,
the others are ``revisit`` records, whose block has the HTTP header alone; its Content-Length is
that of the payload left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, table
from .media import _open

#: Payloads of fewer bytes are stored as often as they occur.
SHARED_FROM = 1000
CHUNK = 64 << 10
#: Bytes of an archive from which on the next record begins another one.
ARCHIVE = 256 << 20
#: Bytes of an archive that a reader takes at a time, at least one record.
SEGMENT = 8 << 20
#: Rows and bytes that a reader hands on at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
DATE = "1970-01-01T00:00:00Z"

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

SEGMENTS = "archive string, first long, past long, records long"
CHUNKS = (
    "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk int, at long, data binary, digest string, last boolean"
)


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, uri, payload, record_type, refers_to) of pages (page_id, url, html; null html: empty).

    Payloads are compared by SHA-256 and length. Rows that share the largest page_id of their
    payload, repeated rows among them, are all responses; a row without an id revisits one that has
    an id, and is a response if none has. The rows that share a payload are counted by digest
    alone; only where the optimiser does not find the table of shared digests small do pages meet it
    through a shuffle, in which a hot digest's rows can be split, as the other side has one row.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= SHARED_FROM
    key = F.unhex(F.sha2("payload", 256))
    shared = p.where(large).groupBy(key.alias("key"), F.octet_length("payload").alias("size")).agg(F.count("*").alias("n"), F.max("page_id").alias("latest"))
    shared = saved(shared.where("n > 1").select("key", "size", "latest"), "shared")
    alone = F.concat(F.lit(b"\0"), F.xxhash64("page_id", "uri").cast("string").cast("binary"))  # matches no digest
    p = p.withColumns({"key": F.when(large, key).otherwise(alone), "size": F.octet_length("payload")}).join(shared, ["key", "size"], "left")
    again = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id"))
    return p.select("page_id", "uri", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("latest")).alias("refers_to"))


def _piece(c: str, chunk: int) -> Column:
    return F.substring(F.col(c), F.col("chunk") * chunk + 1, F.lit(chunk))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of ``decided`` records, a record's together and in order; a revisit or an empty
    payload has one row without bytes."""
    stored = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(0)
    r = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "__last": F.greatest(F.ceil(stored / chunk).cast("int") - 1, F.lit(0))})
    r = r.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    data = F.when(F.col("record_type") == "response", _piece("payload", chunk)).otherwise(F.lit(b""))
    return r.select("page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", data.alias("data"), (F.col("chunk") == F.col("__last")).alias("last"))


def record_id(page_id: int | None, digest: str) -> str:
    """Names a page's record; the digest of its payload is part of the name."""
    return f"<urn:millrace:{'' if page_id is None else page_id}:{digest}>"


def _uri(text: str | None) -> str:
    """A URI that fits into a header line: blanks and control characters in percent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _header(r: dict, date: str) -> bytes:
    """The record's header and the HTTP header that its block begins with."""
    http = HTTP.format(r["payload_bytes"]).encode()
    revisit = r["record_type"] == "revisit"
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["page_id"], r["payload_digest"])), ("WARC-Date", date), ("WARC-Target-URI", _uri(r["uri"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_to"], r["payload_digest"]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else r["payload_bytes"]))]
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]).encode() + http


class _Archive:
    """One archive being written, and its segments."""

    def __init__(self, folder: str, level: int, segment: int):
        fs, base = _open(folder)
        self.name, self.level, self.segment = f"part-{uuid.uuid4().hex}.warc.gz", level, segment
        self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)  # members are compressed here
        self.at, self.begun, self.held, self.segments = 0, 0, 0, []

    def start(self, header: bytes) -> None:
        self.gzip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.add(header)

    def add(self, data: bytes) -> None:
        got = self.gzip.compress(data)
        self.out.write(got)
        self.at += len(got)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        got = self.gzip.flush()
        self.out.write(got)
        self.at, self.held = self.at + len(got), self.held + 1
        if self.at - self.begun >= self.segment:
            self.cut()

    def cut(self) -> None:
        if self.held:
            self.segments.append((self.name, self.begun, self.at, self.held))
        self.begun, self.held = self.at, 0

    def close(self) -> list[tuple]:
        self.cut()
        self.out.close()
        return self.segments


def write(chunks: DataFrame, path: str, archive_bytes: int = ARCHIVE, segment_bytes: int = SEGMENT, level: int = 1, date: str = DATE) -> DataFrame:
    """Write chunk rows below ``path`` and return the table of segments, which is stored there too.

    What a task holds of a record is one chunk. The bytes that it was given must have the length and
    digest that the record's rows name; else the write fails.
    """
    fs, base = _open(path)
    fs.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = digest = None
        size, done = 0, []
        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            small = {n: c.to_pylist() for n, c in columns.items() if n != "data"}
            for k in range(b.num_rows):
                r = {n: c[k] for n, c in small.items()}
                data = columns["data"][k].as_py() or b""
                if r["chunk"] == 0:
                    archive = archive or _Archive(path, level, segment_bytes)
                    archive.start(_header(r, date))
                    digest, size = hashlib.sha1(), 0
                archive.add(data)
                digest.update(data)
                size += len(data)
                if r["last"]:
                    if r["record_type"] == "response" and (size, digest.hexdigest()) != (r["payload_bytes"], r["payload_digest"]):
                        raise ValueError(f"the chunks of page {r['page_id']} are not its payload")
                    archive.end()
                    if archive.at >= archive_bytes:
                        done += archive.close()
                        archive = None
        done += archive.close() if archive else []
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), *[pa.int64()] * 3))], ["archive", "first", "past", "records"])

    return saved(chunks.mapInArrow(run, SEGMENTS), path=f"{path}/segments")


class _Stream:
    """Bytes of the gzip members in a range of a file, decompressed piece by piece."""

    def __init__(self, f, first: int, past: int, piece: int):
        self.f, self.left, self.piece = f, past - first, piece
        f.seek(first)
        self.rest, self.held, self.gzip, self.pending = b"", b"", None, False

    def _more(self) -> bool:
        """Some more bytes of the member; False at its end."""
        if self.gzip is None or self.gzip.eof:
            return False
        if not self.rest and not self.pending:
            self.rest = self.f.read(min(self.piece, self.left))
            self.left -= len(self.rest)
            if not self.rest:
                raise EOFError("an archive ends within a record")
        got = self.gzip.decompress(self.rest, self.piece)
        self.held += got
        self.pending = len(got) == self.piece  # there may be more of what was read
        self.rest = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
        return True

    def member(self) -> bool:
        """Go on to the next record, if there is one."""
        while self._more():
            self.held = b""
        self.held = b""
        if not self.rest and not self.left:
            return False
        self.gzip, self.pending = zlib.decompressobj(31), False
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (k := self.held.find(mark)) < 0:
            if len(self.held) > most or not self._more():
                raise ValueError("a record without the end of its header")
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, fewer only at the record's end."""
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(header: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line is no field."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str) -> int | None:
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def _records(stream: _Stream, chunk: int) -> Iterator[tuple]:
    """Rows of CHUNKS, a record at a time."""
    while stream.member():
        warc = _fields(stream.until(b"\r\n\r\n"))
        if warc.get("warc-type") not in ("response", "revisit"):
            continue
        length, page, digest = int(warc["content-length"]), _page(warc["warc-record-id"]), hashlib.sha1()
        block = stream.until(b"\r\n\r\n")
        left, stated = length - len(block) - 4, int(_fields(block)["content-length"])
        named = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        revisit = warc["warc-type"] == "revisit"
        refers = _page(warc["warc-refers-to"]) if revisit else None
        at = n = 0
        while n == 0 or left:
            data = stream.take(min(chunk, left))
            if left and not data:
                raise EOFError("a record is shorter than its header says")
            left -= len(data)
            digest.update(data)
            so_far = named if revisit else digest.hexdigest()
            if not left and not revisit and (so_far, at + len(data)) != (named, stated):
                raise ValueError(f"the payload of page {page} is not what its header names")
            yield page, warc.get("warc-target-uri"), warc["warc-type"], refers, stated, named, n, at, data, so_far, not left
            at, n = at + len(data), n + 1


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of every record below ``path``: payload_bytes and payload_digest are those that the
    record names, ``digest`` is that of the payload from its start to the chunk's end.

    A response whose bytes are not what its header names is an error.
    """
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    n = max(segments.count(), 1)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_())
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        rows, size = [], 0
        whole = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            for archive, first, past in zip(*(b.column(k).to_pylist() for k in range(3))):
                with fs.open_input_file(f"{base}/{archive}") as f:
                    for row in _records(_Stream(f, first, past, chunk), chunk):
                        rows.append(row)
                        size += len(row[8])
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield whole()
                            rows, size = [], 0
        if rows:
            yield whole()

    return segments.repartition(min(n, 20_000)).mapInArrow(run, CHUNKS)


def summary(chunks: DataFrame) -> DataFrame:
    """One row a record: what its last chunk carries."""
    return chunks.where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def dangling(chunks: DataFrame) -> DataFrame:
    """Revisits without a response of the page and digest that they refer to."""
    ends = chunks.where("last")
    there = ends.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "digest").distinct()
    return ends.where("record_type = 'revisit'").join(there, ["refers_to", "digest"], "left_anti").select("page_id", "refers_to", "digest")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(chunked(decided(table(spark, sf_dir, "pages"))), path)
    return summary(read(spark, path))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
m AS (SELECT html, MAX(page_id) AS latest FROM p WHERE strlen(html) >= {SHARED_FROM} GROUP BY html),
j AS (SELECT p.page_id, p.html, m.latest, m.latest IS NOT NULL AND p.page_id IS DISTINCT FROM m.latest AS again FROM p LEFT JOIN m USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN latest END AS refers_to
FROM j
"""
