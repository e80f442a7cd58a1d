"""Near copies by Jaccard similarity of word shingles: MinHash bands propose, the sets decide.

At a similarity of 0.8 two SimHash fingerprints differ in about a seventh of their bits, far beyond what
Golay keys of 64 bits can be looked up by. So pairs are proposed by BANDS keys of ROWS minima each over
the same shingles (a pair at 0.8 shares a key with probability 1 - (1 - 0.8^5)^24 > 0.9999), and each
is held against the whole sets of its two texts.

Texts of equal sets are one node. Inside a key's bucket each node is first compared to the bucket's
leader only, which is linear. What that leaves in different components is compared pair by pair, a
block against a block, by sketches of BINS bytes: pairs are passed over whose sizes, distances to the
leader (Jaccard distance is a metric) or sketches (at five standard deviations) rule a link out. Only
those that remain are held against each other's sets. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, components, keeps_nothing, saved

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 24, 5
#: Bytes of a sketch, and by how much a sketch may understate a similarity that counts.
BINS, MARGIN = 1024, 0.0625
BLOCK = 1024
#: Leaders that a group of nodes with the same keys has.
LEADERS = 4
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words: none."""
    words = text.translate(_LOWER).split()  # ASCII white space: 9-13 and 32
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - size + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s:e], SEED) for s, e in zip(starts, (ends[min(size, len(words)) - 1 :] - 1).tolist())], np.uint64))


def band_keys(h: np.ndarray) -> list[int]:
    """The BANDS keys of a set that is not empty."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[at : at + 2048, None] ^ _MIX[0]) * _MIX[1]).min(0))
    raw = low.tobytes()
    return [xxhash.xxh64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) for k in range(BANDS)]


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation sketch: for each bin of hashes a byte of the smallest one, 0 if there is none."""
    order = np.sort(h * _U(0x9E3779B97F4A7C15))
    bins = (order >> _U(54)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = 1 + (order[first] * _U(0xD1342543DE82EF95) >> _U(32)) % _U(255)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketches, row by row: equal bins of those that either has."""
    either = (a != 0) | (b != 0)
    return ((a == b) & either).sum(1) / np.maximum(either.sum(1), 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keeps_nothing("similar")
    for b in batches:
        ids, nodes, sizes, keys = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if i is not None and t and len(h := shingles(t)):
                ids.append(i)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                keys += band_keys(h)
        bands = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(np.array(keys, np.uint64).view(np.int64)))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), bands], ["doc_id", "node", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keeps_nothing("similar")
    for b in batches:
        for at in range(0, b.num_rows, 256):
            h = [shingles(t) for t in b.column(1).slice(at, 256).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, h)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(h).view(np.int64)))
            nodes, sketches = [xxhash.xxh3_128_digest(x.tobytes()) for x in h], [sketch(x).tobytes() for x in h]
            yield pa.record_batch([pa.array(nodes, pa.binary()), sets, pa.array(sketches, pa.binary())], ["node", "hashes", "sketch"])


_REST = "key", "lo", "hi", "side", "node", "n", "component", "j", "bands", "sketch"


def _near(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _REST sorted by key, lo, hi. Pairs of nodes that may have the similarity, each
        under the first key that both share."""
        keeps_nothing("similar")
        rest, out = None, []

        def judge(b: pa.RecordBatch, cuts: list[int]) -> None:
            key, side, n, j = (b.column(k).to_numpy() for k in (0, 3, 5, 7))
            node, name = b.column(4).to_pylist(), b.column(6).dictionary_encode().indices.to_numpy()
            flat, at = b.column(8).values.to_numpy(), b.column(8).offsets.to_numpy()
            bands = flat[at[0] : at[-1]].reshape(-1, BANDS)
            sketches = np.frombuffer(b"".join(b.column(9).to_pylist()), np.uint8).reshape(-1, BINS)
            for s, e in zip(cuts[:-1], cuts[1:]):
                own = np.arange(s, e)
                left, right = (own, own) if side[s] == 2 else (own[side[s:e] == 0], own[side[s:e] == 1])
                for at_row in range(0, len(left), 256):
                    a, c = left[at_row : at_row + 256, None], right[None, :]
                    may = (name[a] != name[c]) & (np.minimum(n[a], n[c]) >= similarity * np.maximum(n[a], n[c]) - 1e-9) & (np.abs(j[a] - j[c]) <= 1 - similarity + 1e-9)
                    if side[s] == 2:
                        may &= a < c
                    p, q = np.nonzero(may)
                    p, q = left[at_row + p], right[q]
                    for k in range(0, len(p), 8192):
                        x, y = p[k : k + 8192], q[k : k + 8192]
                        equal = bands[x] == bands[y]
                        first = bands[x, equal.argmax(1)] == key[s]
                        x, y = x[first], y[first]
                        good = alike(sketches[x], sketches[y]) >= similarity - MARGIN
                        out.extend((min(node[i], node[o]), max(node[i], node[o])) for i, o in zip(x[good].tolist(), y[good].tolist()))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], []]
            out.clear()
            return pa.record_batch([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            place = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist()]
            judge(b, cuts)
            rest = b.slice(cuts[-1])
            if len(out) > 10_000:
                yield batch()
        if rest is not None:
            judge(rest, [0, rest.num_rows])
        yield batch()

    return run


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, j): the pairs with their Jaccard similarity."""
    l, r = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return saved(pairs.join(r, "b").join(l, "a").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("j")), "measured")


def edges(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs: (doc_id, text), ids unique. Edges (a, b) of doc_ids that connect texts of Jaccard ``similarity`` or more.

    Rows without an id or without words have none.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = saved(docs.mapInArrow(_sketch, "doc_id long, node binary, n int, bands array<long>"), "sketches")
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    classes = saved(classes, "classes")
    keys = classes.select("node", "n", F.explode(F.array_distinct("bands")).alias("key"))  # nodes are unique
    turn = F.xxhash64("node", F.pmod("key", F.lit(LEADERS)))
    leaders = keys.groupBy("key").agg(F.min(F.struct(turn.alias("t"), "node")).alias("first"), F.count("*").alias("m")).where("m > 1")
    leaders = saved(leaders.select("key", F.col("first.node").alias("leader")), "leaders")
    held = saved(keys.join(leaders, "key"), "buckets")
    pair = (F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    stars = held.where("node <> leader").select(*pair).distinct()
    # A plain table: texts are not shuffled if these ids are few enough to be broadcast.
    reps = saved(held.select("node").distinct().join(classes, "node").select(F.col("rep").alias("doc_id")), "reps")
    sets = saved(docs.join(reps, "doc_id", "left_semi").mapInArrow(_sets, "node binary, hashes array<long>, sketch binary"), "sets")
    first = _measured(stars, sets)
    near = first.where(F.col("j") >= similarity)
    # Buckets in which more than one component is left.
    named = held.join(components(near), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    split = saved(split, "split")
    rest = named.join(split, "key").select("key", "node", "n", "component", *pair).join(first, ["a", "b"], "left")
    rest = saved(rest.select("key", "node", "n", "component", F.coalesce("j", F.lit(1.0)).alias("j")), "rest")
    dealt = block_pairs(rest, ["key"], "node", BLOCK).join(sets.select("node", "sketch"), "node").join(classes.select("node", "bands"), "node")
    dealt = dealt.select(*_REST).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    left = saved(dealt.mapInArrow(_near(similarity), "a binary, b binary"), "left").join(first, ["a", "b"], "left_anti")
    near = near.unionByName(_measured(left, sets).where(F.col("j") >= similarity)).select("a", "b")
    rep = lambda side: classes.select(F.col("node").alias(side), F.col("rep").alias(f"{side}_id"))
    linked = near.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return linked.unionByName(prints.join(classes, "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
