"""Shared pieces of the training-data operators: tables, scratch storage, graph components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text that one task of an operator with a shuffle of whole texts is given, about.
PARTITION_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def scratch(spark: SparkSession, name: str = "data") -> str:
    """A new path below the folder that driver and executors share.

    That folder is ``spark.checkpoint.dir``, or the checkpoint folder set on the context. Where a
    session has neither, a local one (unit tests) gets a temporary folder and any other an error: on
    a cluster a folder of one machine would lose what the others write.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = sc.getCheckpointDir()
    _made.append(f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _made:
            _made.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Remove everything that this process has left in scratch storage. Results that were not
    written or collected before can't be read afterwards."""
    discard(spark, *list(_made))


def saved(df: DataFrame, name: str = "data", path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to shared storage and read back: lineage ends there, and a lost
    executor takes nothing with it."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict = {}


def for_worker(key: tuple, make):
    """What an operator keeps in a worker process between tasks: one thing at a time, so that the
    tables of one operator are gone when another uses the worker."""
    if _kept.get("key") != key:
        _kept.clear()
        give_back()
        _kept.update(key=key, value=make())
    return _kept["value"]


def keeps_nothing(name: str) -> None:
    """Called by tasks of an operator without tables: those of the operator before it go."""
    for_worker((name,), lambda: None)


def give_back() -> None:
    """Free memory that the allocators still hold goes back to the system, where they can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def remainder(column: str, divisor: int):
    """crc32 of the id written in decimal, modulo ``divisor`` (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % divisor


def remainder_of(value: int | None, divisor: int) -> int:
    return 0 if value is None else zlib.crc32(str(value).encode()) % divisor


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def partitions_for(docs: DataFrame, column: str = "text") -> int:
    """Partitions for a shuffle of whole texts: the session's number, or more if the texts are large."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, -(-size // PARTITION_BYTES))


def in_order(docs: DataFrame, partitions: int | None = None, nulls_first: bool = True) -> DataFrame:
    """Rows of docs (doc_id, text, ...) dealt out by ranges of doc_id and sorted within them; equal
    ids in the order of their texts' hashes. An id that a large part of the rows share spreads over
    neighbouring ranges by that hash, and a repeated row by a random number."""
    ids = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
    d = docs.withColumns({"__hash": F.xxhash64("text"), "__salt": F.rand(7)})
    d = d.repartitionByRange(partitions or partitions_for(docs), ids, "__hash", "__salt")
    return d.sortWithinPartitions(ids, "__hash").drop("__hash", "__salt")


def numbered(docs: DataFrame, nulls_first: bool = True) -> DataFrame:
    """docs and __row, unique: doc_id, or, if ids repeat or lack, the place in the order of ``in_order``."""
    d = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    odd = d.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return d.withColumn("__row", F.col("doc_id"))
    return saved(in_order(d, nulls_first=nulls_first).withColumn("__row", F.monotonically_increasing_id()), "numbered")


def block_pairs(rows: DataFrame, keys: list[str], unit: str, block: int) -> DataFrame:
    """rows with lo, hi and side, so that any two rows of a group (equal keys) meet under some (lo, hi).

    A group is cut into blocks of about ``block`` rows by the hash of ``unit``, and each row goes to
    every pair of blocks that its own is in: side 2 for its own block with itself, 0 or 1 otherwise.
    Groups of one row are dropped.
    """
    full = rows.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    full = saved(full, "blocks")  # a table of its own, so that the join can split a large group
    each = rows.join(full, keys).withColumn("own", F.pmod(F.xxhash64(unit), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    each = each.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": side})
    return each.drop("own", "other", "blocks")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    edges: two long columns. Returns (node, component) for each node that is not the smallest of
    its component; component is the smallest node reachable. Work a round is linear in the edges,
    minima are combined before the shuffle, and each round ends in shared storage. Minima are a
    table of their own, so that a join with the edges of a hub can be split.
    """
    spark = edges.sparkSession
    low, high = F.least(a, b), F.greatest(a, b)
    paths = [scratch(spark, "edges")]
    e = saved(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), path=paths[0])

    def mark(df):
        return df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()

    before = mark(e)
    while before[0]:
        paths += [scratch(spark, "edges") for _ in range(4)]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), path=paths[1])
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, path=paths[2])
        m = saved(large.groupBy("u").agg(F.min("v").alias("m")), path=paths[3])
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), path=paths[4])
        discard(spark, *paths[:4])
        paths, after = paths[4:], mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
