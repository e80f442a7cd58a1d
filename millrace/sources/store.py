"""A store: a directory of Parquet tables, each a chain of snapshots and a pointer to the current one.

A snapshot is a list of parts, directories of Parquet files that are never written again. A load
writes a new part and then moves the pointer to a snapshot that holds it, so a failed load leaves
the table as it was and a reader sees a load whole or not at all. An append adds a part; nothing is
rewritten. What is written with keys is a part for each range of them, and a merge rewrites only the
parts in which one of its keys occurs. All access goes through Spark and Hadoop file systems, so any
store they know will do.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField, StructType, VariantType

from . import structure

#: Directories of key ranges within what one load wrote.
SLICE = "__slice"
#: Keys that are looked up one by one, through the Bloom filters and page indexes of the files; more are looked up by their range.
LOOKED_UP = 200


_made: list[str] = []


def staging(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or the
    checkpoint folder set on the context; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    _made.append(f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Remove what this process has left in staging folders; results that still read it are lost."""
    for path in list(_made):
        remove(spark, path)


def checksum(df: DataFrame):
    """A column that adds up to the same number for the same rows in any order, of all columns that can be hashed."""
    hashed = [structure.col(f.name) for f in df.schema if not isinstance(f.dataType, MapType | VariantType)]
    return F.coalesce(F.sum(F.xxhash64(*hashed).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")) if hashed else F.lit(0).cast("decimal(30,0)")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> list[str]:
        """Names of complete pointers, oldest first; the last is current."""
        fs, p = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("current-"))

    def tables(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_") and self.exists(s.getPath().getName()))

    def exists(self, table: str) -> bool:
        return bool(self._pointers(table))

    def parts(self, table: str) -> list[str]:
        """Directories of the current snapshot."""
        pointers = self._pointers(table)
        if not pointers:
            raise FileNotFoundError(f"no table {table} in {self.path}")
        return self._text(f"{self.path}/{table}/{pointers[-1]}").split()

    def _text(self, path: str) -> str:
        """A small file."""
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(b & 255 for b in stream.readNBytes(fs.getFileStatus(p).getLen())).decode()
        finally:
            stream.close()

    def _publish(self, text: str, aside: str, final: str) -> bool:
        """A small file under its final name, unless that is taken: of several callers one succeeds, and
        no reader sees half of it. Written aside and renamed, which HDFS refuses where the name is
        taken; a local file system would replace, so there the name is a link. On a store that
        replaces on rename (object stores) two loads at a time are not kept apart."""
        fs, a = self._fs(aside)
        stream = fs.create(a, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        _, f = self._fs(final)
        done = False
        if fs.getUri().getScheme() == "file":
            try:
                os.link(a.toUri().getPath(), f.toUri().getPath())
                done = True
            except FileExistsError:
                pass
        elif not fs.exists(f) and fs.rename(a, f):
            return True
        fs.delete(a, False)
        return done

    def _point(self, table: str, parts: list[str], after: str | None) -> None:
        """The parts become the table under the pointer's next number; if another load took that first,
        this one fails."""
        self._snapshot(table, parts, int(after.split("-")[1]) + 1 if after else 0)
        if after:
            fs, _ = self._fs(f"{self.path}/{table}")
            for name in self._pointers(table)[:-2]:  # the one before stays for readers that have just listed it
                fs.delete(self._fs(f"{self.path}/{table}/{name}")[1], False)

    def _snapshot(self, table: str, parts: list[str], number: int) -> None:
        if not self._publish("\n".join(parts), f"{self.path}/{table}/_pending-{uuid.uuid4().hex}", f"{self.path}/{table}/current-{number:012d}"):
            raise RuntimeError(f"another load has changed {table}")

    def _part(self, table: str, df: DataFrame, keys: Sequence[str] = (), seen: Observation | None = None, filtered: Sequence[str] = ()) -> list[str]:
        """Parts with these rows: one, or with keys one for each range of them, as many as Spark makes
        of a shuffle's partitions for their bytes. ``seen`` gets rows and checksum of what is written.
        Files have Bloom filters on the keys, on those ``filtered``, or on the key that the table declares."""
        name = f"p-{uuid.uuid4().hex}"
        path = f"{self.path}/{table}/{name}"
        if keys:
            df = df.repartitionByRange(*[structure.col(k) for k in keys])
        blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys or filtered or structure.keys(df.schema)}
        blooms |= {"parquet.bloom.filter.adaptive.enabled": "true"} if blooms else {}
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), checksum(df).alias("checksum")) if seen else df
        if keys:
            watched.withColumn(SLICE, F.spark_partition_id()).write.options(**blooms).partitionBy(SLICE).parquet(path)
            fs, p = self._fs(path)
            slices = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
            if slices:
                return [f"{name}/{s}" for s in slices]
            watched = df.limit(0)  # no rows, so no slice that holds the columns
        watched.write.options(**blooms).mode("append").parquet(path)
        return [name]

    def _typed(self, table: str, df: DataFrame, add: bool = False) -> DataFrame:
        return structure.conform(df, self.read(table).schema, add)

    def _at(self, table: str, parts: Sequence[str]) -> list[str]:
        return [f"{self.path}/{table}/{p}" for p in parts]

    def read(self, table: str) -> DataFrame:
        """The rows, with the columns of the part written last; a column that was added since a part
        was written is null there."""
        paths = self._at(table, self.parts(table))
        return self.spark.read.schema(self.spark.read.parquet(paths[-1]).schema).parquet(*paths)

    def write(self, table: str, df: DataFrame, keys: Sequence[str] = ()) -> None:
        """A new snapshot of these rows becomes the table."""
        after = (self._pointers(table) or [None])[-1]
        self._point(table, self._part(table, df, keys), after)

    def append(self, table: str, df: DataFrame, keys: Sequence[str] = (), add: bool = False) -> None:
        """A snapshot with these rows added becomes the table; nothing is rewritten. Columns that the
        table lacks are an error, or are added to it."""
        after, parts = self._pointers(table)[-1], self.parts(table)
        self._point(table, [*parts, *self._part(table, self._typed(table, df, add), keys)], after)

    def near(self, table: str, changes: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        """Rows of the table among which all are that have a key of the changes; None: there are none.

        A few keys are looked up by value: files, row groups and pages whose statistics or Bloom filter
        exclude them all are not read. Of more, only what reaches into the range of the first key.
        """
        first, whole = keys[0], self.read(table)
        few = [r[0] for r in changes.select(first).limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            few = {v for v in few if v is not None}
            return whole.where(F.col(first).isin(*few)) if few else None
        low, high = changes.dropna(subset=list(keys)).agg(F.min(first), F.max(first)).first()
        return None if low is None else whole.where(F.col(first).between(F.lit(low), F.lit(high)))

    @contextmanager
    def _values_pushed(self) -> Iterator[None]:
        """Lists of values reach the files as they are, not as their range."""
        name = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(max(int(before), LOOKED_UP)))
        yield

    def _touched(self, table: str, changes: DataFrame, keys: Sequence[str]) -> dict[str, int]:
        """Parts in which a key of the changes occurs, and how many of their rows have one. Only keys are
        read, of what is ``near``."""
        near = self.near(table, changes, keys)
        if near is None:
            return {}
        part = F.regexp_extract("_metadata.file_path", f"/(p-[0-9a-f]+(/{SLICE}=[0-9]+)?)/[^/]+$", 1).alias("__part")
        found = near.select(*keys, part).join(changes.select(*keys), list(keys), "left_semi").groupBy("__part").count()
        with self._values_pushed():
            return {r[0]: r[1] for r in found.collect()}  # some of the names that the pointer lists

    def _of_parts(self, table: str, parts: Sequence[str]) -> DataFrame:
        """Rows of some parts, with the table's columns."""
        whole = self.read(table)
        return self.spark.read.schema(whole.schema).parquet(*self._at(table, parts)) if parts else whole.limit(0)

    def merge(self, table: str, changes: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The table becomes ``combine(its rows, changes)``, where rows whose key is not among the changes
        have to stay. Only parts in which such a key occurs are read whole and written anew."""
        after, parts = self._pointers(table)[-1], self.parts(table)
        changes = self._typed(table, changes)
        touched = self._touched(table, changes, keys)
        old = self._of_parts(table, [p for p in parts if p in touched])
        new = structure.declare(combine(old, changes), {f.name: f.metadata for f in old.schema})
        self._point(table, [*(p for p in parts if p not in touched), *self._part(table, new, keys)], after)

    def alter(self, table: str, entries: dict[str, dict], add: Sequence[StructField] = ()) -> None:
        """Columns promise something else (an entry of None is taken back), and columns are added; no
        row is rewritten or checked. Rows that are there have an added column's default, which has to
        be constant, or null."""
        after, parts, shape = self._pointers(table)[-1], self.parts(table), self.read(table).schema
        if unknown := set(entries) - set(shape.names):
            raise structure.ColumnMismatch(f"there is no column {', '.join(sorted(unknown))}")
        changed = [StructField(f.name, f.dataType, True, {k: v for k, v in {**f.metadata, **entries.get(f.name, {})}.items() if v is not None}) for f in shape]
        more = [StructField(f.name, f.dataType, True, {**f.metadata, **({"EXISTS_DEFAULT": f.metadata["default"]} if "default" in f.metadata else {})}) for f in add]
        empty = self.spark.createDataFrame([], StructType(changed + more))
        self._point(table, [*parts, *self._part(table, empty)], after)

    def keys(self, table: str) -> list[str]:
        """Columns of the primary key that the table declares."""
        return structure.keys(self.read(table).schema)

    def references(self, table: str) -> list[tuple[str, str, str]]:
        """(column, parent, parent's column) of the foreign keys that the table declares."""
        return sorted((f.name, *f.metadata["references"].rpartition(".")[::2]) for f in self.read(table).schema if "references" in f.metadata)

    def clone_schema(self, table: str, source: Store) -> None:
        """An empty table with the source's columns and what they promise, unless there is one."""
        if not self.exists(table):
            self.write(table, source.read(table).limit(0))

    def create(self, table: str, shape) -> None:
        """An empty table with this structure."""
        self.write(table, self.spark.createDataFrame([], shape))

    def truncate(self, table: str) -> None:
        self.write(table, self.read(table).limit(0))

    def drop(self, table: str) -> None:
        fs, p = self._fs(f"{self.path}/{table}")
        fs.delete(p, True)

    def vacuum(self, table: str) -> None:
        """Remove parts and pointers of snapshots that are no longer current, and what failed loads left."""
        keep = {*self.parts(table), self._pointers(table)[-1]}
        sliced = {k.partition("/")[0] for k in keep if "/" in k}
        fs, p = self._fs(f"{self.path}/{table}")
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name in sliced:
                for x in fs.listStatus(s.getPath()):
                    if f"{name}/{x.getPath().getName()}" not in keep:
                        fs.delete(x.getPath(), True)
            elif name not in keep:
                fs.delete(s.getPath(), True)

    def count(self, table: str) -> int:
        return self.read(table).count() if self.exists(table) else 0

    def size(self, table: str) -> int:
        """Bytes of the current snapshot's files."""
        return sum(fs.getContentSummary(p).getLength() for fs, p in (self._fs(f"{self.path}/{table}/{x}") for x in self.parts(table)))

    def analyze(self, table: str) -> DataFrame:
        """(column_name, nulls, distinct_values, min, max) of the table, estimated for distinct values, from one pass."""
        df = self.read(table)
        one = lambda c: F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct_values"),
            F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
        )
        return df.agg(F.array(*[one(c) for c in df.columns]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
