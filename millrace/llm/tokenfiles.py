"""Token ids as ORC files.

A file is a contiguous range of doc_id in ascending order, its rows numbered from 0. Its stripes hold ids as run-length
encoded integers, with row indexes and a Bloom filter on doc_id, so that readers split files by
stripe and skip stripes and row groups whose statistics or filter exclude the ids asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_order, saved, scratch, table
from .encoding import encoder

END = 2
SCHEMA = "doc_id bigint, row bigint, ids array<int>"


def encode(docs: DataFrame, path: str, kind: str = "word", end: int | None = END) -> DataFrame:
    """(doc_id, row, ids) of each whole text (null: empty), in the order of the rows given; row counts
    those of a partition from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, tail = encoder(path, kind), 0, b"" if end is None else np.array([end], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [x + tail for x in own.encode(part.column(1).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                place = pa.array(np.arange(row, row + len(ids)))
                row += len(ids)
                yield pa.record_batch([part.column(0), place, pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "row", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write(docs: DataFrame, out: str, tokenizer_path: str, kind: str = "word", end: int | None = END, partitions: int | None = None, stripe_bytes: int = 64 << 20, stride: int = 10_000) -> None:
    """Encode ``docs`` (doc_id, text) and write them below ``out`` in ascending doc_id order.

    Texts are dealt by range of doc_id before they are encoded, so nothing is encoded twice. Equal
    ids follow each other in the order of their texts' hashes, repeated rows are written as often as
    they occur, null ids come first, and an empty table gives files without rows. Other columns are
    ignored. A text of any length is encoded whole, in one task, and is one row.
    """
    d = in_order(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partitions)
    (
        encode(d, tokenizer_path, kind, end)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", stride)
        .option("orc.stripe.size", stripe_bytes).option("compression", "zstd").orc(out)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, row, ids); with ``doc_ids`` the filter reaches the files' statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file's rows are summed in the file, files by a running sum over one row each, both in the
    order in which they were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), sizes, pa.array(crc, pa.int64())], ["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    rows = read(spark, path).select("doc_id", "ids", "row", F.input_file_name().alias("file"))
    rows = rows.mapInArrow(run, "doc_id long, row long, file string, n_tokens long, ids_crc32 long")
    rows = saved(rows.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("long")), "digest")  # the files are read once
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_tokens(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), out, tokenizer_path)
    return digest(spark, out)
