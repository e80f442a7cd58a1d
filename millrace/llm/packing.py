"""Packing documents into token sequences by order-preserving dynamic programming.

Documents follow each other in ascending doc_id. A sequence is a window of that stream. Windows are
cut where a document ends, where a sentence ends (at a small penalty) or, at a large one, anywhere
in between; the cuts that minimise padding plus penalties are found by dynamic programming. A
window of L ids costs ``limit - L`` of padding, none if L is a power of two, so the best start of a
window ending at j is the minimum of cost(i) + position(i) over the positions within reach, kept in
a monotone queue, or one of the few positions a power of two before.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_order, saved, table
from .encoding import encoder

LIMIT = 1024
END = 0
SENTENCE_PENALTY = 2.0
BREAK_PENALTY = 24.0
BLOCK = 1 << 18  # ids that are planned at once
_SENTENCE = re.compile(r"[.!?…][\"')\]]*\s*$|\n$")


def padded(length: int, limit: int = LIMIT) -> int:
    """Stored length of a sequence: the limit, or its own length if that is a power of two."""
    return length if length & (length - 1) == 0 else limit


def plan(positions: list[int], penalties: list[float], limit: int = LIMIT) -> list[int]:
    """positions: ascending cut positions, the first a start; neighbours at most ``limit`` apart.

    Returns the cuts chosen, first and last position included, of least cost.
    """
    n = len(positions)
    place = np.array(positions)
    at = place - place[0]
    known = np.full(int(at[-1]) + 1, -1, np.int32)
    known[at] = np.arange(n)
    powers = 1 << np.arange((limit - 1).bit_length())  # the limit itself is no better than any other length within it
    before = at[:, None] - powers
    start = np.where(before >= 0, known[np.maximum(before, 0)], -1)
    j, p = np.nonzero(start >= 0)
    exact = zip(start[j, p].tolist(), powers[p].tolist())  # positions a power of two before others, and these powers
    near = np.bincount(j, minlength=n).tolist()  # how many of them each position has
    reach = np.searchsorted(place, place - limit).tolist()  # the first start within the limit
    sums, back = [float(positions[0])], [0]  # cost of a cut at each position, plus that position
    values, starts, head = [sums[0]], [0], 0  # sums, ascending from head on
    for j in range(1, n):
        first = reach[j]
        while starts[head] < first:
            head += 1
        i = starts[head]
        best = values[head] + limit
        if near[j]:  # lengths without padding
            for k, p in islice(exact, near[j]):
                v = sums[k] + p
                if v < best:
                    best, i = v, k
        best += penalties[j]
        sums.append(best)
        back.append(i)
        while len(values) > head and values[-1] >= best:
            values.pop()
            starts.pop()
        values.append(best)
        starts.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return [positions[k] for k in reversed(cuts)]


class Packer:
    """Packs a stream of documents; holds about one block of ids."""

    def __init__(self, ends: np.ndarray, limit: int):
        self.ends, self.limit = ends, limit
        self.docs: list[list] = []  # doc_id, ids, ids placed so far
        self.size, self.sequence = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        sizes = [len(d[1]) - d[2] for d in self.docs]
        doc_ends = np.cumsum(sizes)
        stream = np.concatenate([d[1][d[2] :] for d in self.docs])
        penalty = np.full(len(stream) + 1, np.nan)
        penalty[1:][self.ends[stream]] = SENTENCE_PENALTY
        penalty[doc_ends] = 0
        penalty[0] = 0
        known = np.flatnonzero(~np.isnan(penalty))
        # Longer stretches without a sentence's end are cut anywhere, on a grid and near the end.
        for k in np.flatnonzero(np.diff(known) > 64).tolist():
            penalty[known[k] + 32 : known[k + 1] : 32] = BREAK_PENALTY
        known = np.flatnonzero(~np.isnan(penalty))
        cuts = plan(known.tolist(), penalty[known].tolist(), self.limit)
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]  # the last window is planned again with what follows
        starts, ends = (doc_ends - sizes).tolist(), doc_ends.tolist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            offset = 0
            d = bisect_left(ends, s + 1) if s == cuts[0] else d
            while offset < e - s:
                doc = self.docs[d]
                n = min(starts[d] + sizes[d], e) - (s + offset)
                yield doc[0], doc[2], n, zlib.crc32(doc[1][doc[2] : doc[2] + n].astype("<u4", copy=False)), len(doc[1]), self.sequence, offset
                doc[2] += n
                offset += n
                if doc[2] == len(doc[1]):
                    d += 1
            self.sequence += 1
        self.docs = [d for d in self.docs if d[2] < len(d[1])]
        self.size = sum(len(d[1]) - d[2] for d in self.docs)


_ends: dict[str, np.ndarray] = {}


def sentence_ends(tokenizer_path: str, share: float = 1.0) -> np.ndarray:
    """For each id whether the text of it ends a sentence."""
    if tokenizer_path not in _ends:
        t = encoder(tokenizer_path, "byte", share).tokenizer
        size = t.get_vocab_size()
        _ends[tokenizer_path] = np.array([bool(_SENTENCE.search(t.decode([i], skip_special_tokens=False))) for i in range(size)])
    return _ends[tokenizer_path]


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END, partitions: int | None = None, share: float = 1.0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents (null text: empty) are dealt by range of doc_id and each range is packed as a stream
    of its own, in blocks, so memory is bounded by a block and the longest document. Sequence ids
    are gapless over all ranges. Null ids come first, equal ids follow each other in the order of
    their texts' hashes, repeated rows are packed as often as they occur, an empty table has no
    pieces. Other columns are ignored. ``share`` is the part of the encoder's tables that a worker
    may fill, which changes no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, rows = encoder(tokenizer_path, "byte", share), Packer(sentence_ends(tokenizer_path, share), limit), []
        tail = np.array([end], "<u4").tobytes()

        def out():
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

        for b in batches:
            for at in range(0, b.num_rows, 250):  # not a batch's texts at once
                part = b.slice(at, 250)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    rows.extend(packer.add(doc_id, np.frombuffer(ids + tail, "<u4")))
                    if len(rows) > 10_000:
                        yield out()
        rows.extend(packer.flush(True))
        yield out()

    d = in_order(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partitions)
    pieces = saved(d.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS)).withColumn("shard", F.spark_partition_id()), "pieces")
    shards = pieces.groupBy("shard").agg((F.max("sequence") + 1).alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return pieces.join(shards, "shard").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer())
