"""Media columns: lossless images of payloads in ZIP archives, read by byte range.

``millrace_media`` is a Spark data source. Its writer stores each payload, padded to whole rows, as
an 8-bit grey-scale PNG member of a ZIP archive (members stored, directory entries of equal size, no
archive beyond ``archiveBytes``). Its reader plans partitions by cutting the archives into byte
ranges: a range owns the members that begin in it, found by binary search in the archive's
directory. Where there are more ranges than ``partitions`` says, each task takes several, one after
another, so that the plan stays small over any number of archives. Neighbouring members are fetched
together and streamed as Arrow batches; a member that arrives damaged is fetched again by its own
offset, as often as ``retries`` says, while the others go on. Files are opened through pyarrow's
file systems, so any store it knows will do.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import scratch, table

FORMAT = "millrace_media"
WIDTH = 192
PAD = b" "
_NAME = 24  # bytes of a member's name: 20 for the id, ".png"
_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_ENTRY_SIZE = _ENTRY.size + _NAME
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MANIFEST = "_archives"


def pad(payload: bytes) -> bytes:
    """Blanks up to a positive multiple of the width."""
    return payload + PAD * (-len(payload) % WIDTH if payload else WIDTH)


def to_png(payload: bytes) -> bytes:
    """An image WIDTH samples wide; a text chunk holds the length without padding."""
    samples = np.frombuffer(pad(payload), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = samples

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">2I5B", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"tEXt", b"Length\0%d" % len(payload)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows x WIDTH) and the unpadded length of an image made by ``to_png``."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, parts, length, shape = 8, [], 0, (0, 0)
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">2I2B", data)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey-scale images are read")
            shape = height, width
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:], length


def feature(samples: np.ndarray) -> str:
    """Rows, mean sample to three places and a 16-bin histogram."""
    bins = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"{len(samples)};{samples.mean():.3f};" + ",".join(map(str, bins.tolist()))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it. ``s3a`` is what Spark calls ``s3``."""
    scheme, sep, rest = path.partition("://")
    if sep:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme == "s3a" else path)
    return pafs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


class _Archive:
    """One ZIP archive being written."""

    def __init__(self, folder: str):
        self.fs, base = _open(folder)
        self.name = f"part-{uuid.uuid4().hex}.zip"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}")
        self.entries, self.at = [], 0

    def add(self, doc_id: int | None, media: bytes) -> None:
        name = (b"%020d" % doc_id if doc_id is not None else b"null" + b"0" * 16) + b".png"
        crc, size = zlib.crc32(media), len(media)
        self.out.write(_LOCAL.pack(b"PK\3\4", 20, 0, 0, 0, 33, crc, size, size, _NAME, 0) + name + media)
        self.entries.append(_ENTRY.pack(b"PK\1\2", 20, 20, 0, 0, 0, 33, crc, size, size, _NAME, 0, 0, 0, 0, 0, self.at) + name)
        self.at += _LOCAL.size + _NAME + size

    def close(self) -> dict:
        n, directory = len(self.entries), b"".join(self.entries)
        self.out.write(directory + _END.pack(b"PK\5\6", 0, 0, n, n, len(directory), self.at, 0))
        self.out.close()
        return {"name": self.name, "members": n, "directory": self.at}


@dataclass
class _Written(WriterCommitMessage):
    archives: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.limit = options["path"], int(options.get("archivebytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, archive = [], None
        for b in iterator:
            for doc_id, payload in zip(b.column(0).to_pylist(), b.column(1)):
                archive = archive or _Archive(self.folder)
                archive.add(doc_id, to_png(payload.as_py() or b""))
                if archive.at >= self.limit or len(archive.entries) >= 65_000:
                    done.append(archive.close())
                    archive = None
        return _Written(done + ([archive.close()] if archive else []))

    def commit(self, messages: list) -> None:
        """Only archives that the manifest names count, so a lost task's leave no trace in a read."""
        fs, base = _open(self.folder)
        with fs.open_output_stream(f"{base}/{_MANIFEST}-{uuid.uuid4().hex}.json") as out:
            for m in messages:
                for a in m.archives if m else ():
                    out.write(json.dumps(a).encode() + b"\n")

    def abort(self, messages: list) -> None:
        fs, base = _open(self.folder)
        for m in messages:
            for a in m.archives if m else ():
                fs.delete_file(f"{base}/{a['name']}")


@dataclass
class _Range(InputPartition):
    name: str
    first: int
    past: int
    members: int
    directory: int
    then: tuple = ()  # ranges that the same task reads after this one


class _Reader(DataSourceReader):
    BATCH = 8 << 20

    def __init__(self, options: dict):
        self.folder, self.step = options["path"], int(options.get("splitbytes", 32 << 20))
        self.most, self.retries = int(options.get("partitions", 50_000)), int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        fs, base = _open(self.folder)
        archives = []
        for info in fs.get_file_info(pafs.FileSelector(base)):
            if info.base_name.startswith(_MANIFEST):
                with fs.open_input_stream(info.path) as f:
                    archives += map(json.loads, f.read().splitlines())
        share = max(self.step, -(-sum(a["directory"] for a in archives) // self.most))
        out, held = [], share
        for a in archives:
            for s in range(0, a["directory"], share):
                r = _Range(a["name"], s, min(s + share, a["directory"]), a["members"], a["directory"])
                if share == self.step or held + r.past - s > share:
                    out.append([])
                    held = 0
                out[-1].append(r)
                held += r.past - s
        return [replace(first, then=tuple(more)) for first, *more in out] or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.members:
            fs, base = _open(self.folder)
            for p in (partition, *partition.then):
                yield from self._range(fs, base, p)

    def _range(self, fs, base: str, p: _Range) -> Iterator[pa.RecordBatch]:
        path = f"{base}/{p.name}"
        with fs.open_input_file(path) as f:
            entry = lambda k, n=1: f.read_at(n * _ENTRY_SIZE, p.directory + k * _ENTRY_SIZE)
            low, high = 0, p.members
            while low < high:  # the first member that begins in the range
                mid = (low + high) // 2
                low, high = (mid + 1, high) if _ENTRY.unpack_from(entry(mid))[-1] < p.first else (low, mid)
            run: list[tuple] = []
            while low < p.members:
                n = min(512, p.members - low)
                block = entry(low, n)
                for k in range(n):
                    e = _ENTRY.unpack_from(block, k * _ENTRY_SIZE)
                    if e[-1] >= p.past:
                        low = p.members
                        break
                    name = block[k * _ENTRY_SIZE + _ENTRY.size : (k + 1) * _ENTRY_SIZE]
                    run.append((name, e[-1] + _LOCAL.size + _NAME, e[8], e[7]))
                    if run[-1][1] + run[-1][2] - run[0][1] >= self.BATCH:
                        yield self._fetch(fs, path, f, run)
                        run = []
                low += n
            if run:
                yield self._fetch(fs, path, f, run)

    def _fetch(self, fs, path: str, f, run: list[tuple]) -> pa.RecordBatch:
        first = run[0][1]
        try:
            span = f.read_at(run[-1][1] + run[-1][2] - first, first)
        except OSError:
            span = b""
        ids, media = [], []
        for name, at, size, crc in run:
            data = span[at - first : at - first + size]
            data = data if len(data) == size and zlib.crc32(data) == crc else self.member(fs, path, at, size, crc)
            ids.append(None if name.startswith(b"null") else int(name[:20]))
            media.append(data)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    def member(self, fs, path: str, at: int, size: int, crc: int) -> bytes:
        """One member by its offset, on a fresh handle each time."""
        why: object = "damaged"
        for _ in range(self.retries):
            try:
                with fs.open_input_file(path) as f:
                    data = f.read_at(size, at)
                if len(data) == size and zlib.crc32(data) == crc:
                    return data
            except OSError as e:
                why = e
        raise OSError(f"{path}: member at {at} can't be read in {self.retries} attempts: {why}")


class MediaArchives(DataSource):
    """Options: path; archiveBytes (writing); splitBytes, partitions (at most about twice that many), retries (reading)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write(docs: DataFrame, path: str, **options) -> None:
    """Store docs (doc_id, text or binary; null: empty) below ``path``; other columns are ignored."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    fs, base = _open(path)
    fs.create_dir(base)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("media"))
    d.write.format(FORMAT).mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, media) of every archive below ``path``."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).options(**options).load(path)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """What the stored images hold. Repeated rows are kept; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1)):
                stored = value.as_py()
                samples, length = from_png(stored)
                payload = samples.tobytes()
                rows.append((doc_id, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    text = {"payload_sha256", "media_sha256", "feature"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c in text else pa.int64() for c in names]
    return media.mapInArrow(run, SCHEMA)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    write(table(spark, sf_dir, "documents"), path)
    return describe(read(spark, path))
