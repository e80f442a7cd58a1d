"""Backups of stores: parts are copied as files, and only those that the backup lacks.

Parts are never written again, so one that a snapshot of the backup lists is whole and the same. A
backup keeps every snapshot; restoring one copies back what the target lacks of it.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from millrace.sources.catalog_source import _open
from millrace.sources.store import Store


def snapshots(store: Store, table: str) -> dict[int, list[str]]:
    """Parts of each snapshot of a table by its number."""
    return {int(n.split("-")[1]): store._text(f"{store.path}/{table}/{n}").split() for n in store._pointers(table)}


def _files(store: Store, table: str, part: str) -> list[str]:
    """Paths below the table of a part's files."""
    fs, p = store._fs(f"{store.path}/{table}/{part}")
    found, out, base = fs.listFiles(p, True), [], fs.makeQualified(store._fs(f"{store.path}/{table}")[1]).toString()
    while found.hasNext():
        path = found.next().getPath().toString()
        if not path.rpartition("/")[2].startswith((".", "_")):
            out.append(path.removeprefix(base).lstrip("/"))
    return out


def _copied(spark: SparkSession, pairs: list[tuple[str, str]]) -> int:
    """Files copied by tasks, a file each; the bytes. A file gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (a, x), (c, y) = _open(source), _open(target)
                c.create_dir(y.rpartition("/")[0])
                aside = f"{y}.{uuid.uuid4().hex}"
                with a.open_input_stream(x, compression=None) as i, c.open_output_stream(aside, compression=None) as o:
                    shutil.copyfileobj(i, o, 4 << 20)
                c.move(aside, y)
                yield pa.record_batch([pa.array([c.get_file_info(y).size], pa.int64())], ["bytes"])

    if not pairs:
        return 0
    rows = spark.createDataFrame(pairs, "source string, target string").repartition(min(len(pairs), 10_000))
    return rows.mapInArrow(run, "bytes long").groupBy().sum("bytes").first()[0]


def _move(source: Store, to: Store, table: str, parts: list[str]) -> int:
    have = {p for s in snapshots(to, table).values() for p in s}
    pairs = [(f"{source.path}/{table}/{f}", f"{to.path}/{table}/{f}") for p in parts if p not in have for f in _files(source, table, p)]
    return _copied(source.spark, pairs)


def backup(source: Store, to: Store, tables: Iterable[str] | None = None) -> dict[str, int]:
    """The current snapshots of a store's tables become the newest of the backup's; bytes copied by table."""
    out = {}
    for t in tables if tables is not None else source.tables():
        parts = source.parts(t)
        out[t] = _move(source, to, t, parts)
        numbers = snapshots(to, t)
        if not numbers or numbers[max(numbers)] != parts:
            to._snapshot(t, parts, max(numbers, default=-1) + 1)
    return out


def restore(backup: Store, to: Store, table: str, number: int | None = None) -> int:
    """A snapshot of the backup, the newest unless told, becomes the target's table; bytes copied."""
    have = snapshots(backup, table)
    parts = have[max(have) if number is None else number]
    copied = _move(backup, to, table, parts)
    to._point(table, parts, (to._pointers(table) or [None])[-1])
    return copied
