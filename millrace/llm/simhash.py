"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at
most two bits, a segment agrees wholly and the next one (cyclically) differs in at most one bit:
of the three segments, errors (2,0,0), (1,1,0) and their rotations all leave such a pair. A segment
that differs in at most one bit is matched by the perfect binary Golay code [23,12,7]: the codeword
that one side decodes to is among those that the other side's neighbourhood of radius one decodes
to, at most six. So each fingerprint has three keys to be found by and at most eighteen to look
with, of at least 30 bits; candidates are verified by Hamming distance.

A key that more than ``bucket_cap`` fingerprints share is not expanded into pairs. Fingerprints of
such keys are linked exactly through midpoints: two of them differ in at most two bits if and only
if some word lies within one bit of both, so each is listed under the 65 words of its ball and all
of a word are joined to the smallest. That is linear in the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar
from .common import components, keeps_nothing, saved, table

SHINGLE_WORDS = 3
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash over word shingles, repeats counted; no words: 0."""
    words = text.translate(_LOWER).split()  # ASCII white space: 9-13 and 32
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE_WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist())], np.uint64)
    columns = h.view(np.uint8).reshape(-1, 8)  # little-endian
    value = 0
    for k in range(8):
        ones = np.bincount(columns[:, k], minlength=256) @ _BITS
        for j in np.flatnonzero(2 * ones > len(h)).tolist():
            value |= 1 << (8 * k + j)
    return value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("simhash")
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0b101011100011


def _syndromes(v: np.ndarray) -> np.ndarray:
    s = v.copy()
    for bit in range(22, 10, -1):
        s ^= np.where((s >> bit) & 1, GENERATOR << (bit - 11), 0)
    return s


def _error_table() -> np.ndarray:
    """For each syndrome the one error pattern of weight at most three."""
    one = 1 << np.arange(23, dtype=np.int64)
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(23)] * 3, indexing="ij"))
    patterns = np.unique(np.concatenate([[0], one[i] | one[j] | one[k]]))  # 2048 patterns
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


ERRORS = _error_table()


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (v ^ ERRORS[_syndromes(v)]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp: uint64. Keys to be found by (n, 3), and to look with (n, 3, 24), repeats as -1."""
    u = fp.astype(np.uint64)
    seg = [(u >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in ((0, 23), (23, 23), (46, 18))]
    found, look = [], []
    for t in range(3):
        exact, near = seg[t], seg[(t + 1) % 3]
        high = (np.int64(t) << 60) | (exact << 12)
        ball = np.stack([near, *(near ^ (1 << i) for i in range(23))], 1)
        index = np.sort(decode(ball.ravel()).reshape(ball.shape), 1)
        keys = high[:, None] | index
        keys[:, 1:][index[:, 1:] == index[:, :-1]] = -1
        found.append(high | decode(near))
        look.append(keys)
    return np.stack(found, 1), np.stack(look, 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keeps_nothing("simhash")
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            found, look = golay_keys(fp.view(np.uint64))
            keep = look.reshape(len(fp), -1) >= 0
            row = np.concatenate([np.repeat(np.arange(len(fp)), 3), np.nonzero(keep)[0]])
            key = np.concatenate([found.ravel(), look.reshape(len(fp), -1)[keep]])
            side = np.concatenate([np.zeros(found.size, bool), np.ones(int(keep.sum()), bool)])
            yield pa.record_batch([pa.array(fp[row]), pa.array(key), pa.array(side)], ["fp", "key", "looks"])


def links(prints: DataFrame, bucket_cap: int = 128, distance: int = 2) -> DataFrame:
    """prints: distinct fp. Edges (a, b) between fingerprints that connect what is linked at ``distance`` (2 at most)."""
    keys = saved(prints.select("fp").mapInArrow(_keys, "fp long, key long, looks boolean"), "keys")
    found, look = keys.where("not looks"), keys.where("looks")
    hot = saved(found.groupBy("key").count().where(F.col("count") > bucket_cap).select("key"), "hot")
    l, r = found.join(hot, "key", "left_anti").alias("l"), look.alias("r")
    close = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance
    near = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") != F.col("r.fp")) & close)
    near = near.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b"))
    # Either side of a link over a hot key holds it among the keys it looks with.
    flipped = lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    ball = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(flipped(i)))
    crowded = look.join(hot, "key", "left_semi").select("fp").distinct()
    listed = crowded.select("fp", F.explode(ball).alias("word"))
    least = listed.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = listed.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.unionByName(star)


def near_duplicates(docs: DataFrame, bucket_cap: int = 128) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null or blank texts have fingerprint zero and are linked like any other. Every row is a document
    of its own: rows that repeat an id, or lack one, are linked by their texts alone, and repeated
    rows stay repeated. component_id is the smallest id reachable, null where no row of the component
    has one. Other columns of ``docs`` are ignored, an empty table gives an empty result. A text of
    any length is read whole, in one task.
    """
    prints = saved(fingerprints(docs), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    c = components(links(classes, bucket_cap)).withColumnRenamed("node", "fp")
    group = classes.join(c, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    group = saved(group.join(least, "component").select("fp", "component_id"), "groups")  # a plain table: a large group's join can be split
    return prints.join(group, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups(docs: DataFrame, similarity: float, bucket_cap: int = 128) -> DataFrame:
    """docs: (doc_id, text), ids unique and not null. (node, component) as ``components`` gives them,
    of documents linked by their fingerprints, as above, or by a Jaccard ``similarity`` of their
    five-word shingles."""
    prints = saved(fingerprints(docs), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    rep = lambda side: classes.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}"))
    linked = links(classes, bucket_cap).join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = prints.join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(linked.unionByName(same).unionByName(similar.edges(docs, similarity)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
