"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the
signed axis that it then lies nearest to. A table's key joins several such hashes, as many as keep
unrelated vectors apart at the number of vectors there are; besides its own, a vector has the keys
of its next best axes (multiprobe). The number of tables is what finds at least ``RECALL`` of simulated
pairs at the cosine asked for, in the dimension at hand.

Vectors that share a key meet in a bucket, where every pair of them is verified by cosine in double
precision, a block of vectors against a block at a time. Buckets of any size are dealt out by pairs
of blocks, so no task holds more than two blocks, and nothing is emitted for pairs: only link counts
for each vector and the spanning edges of a block's components. A pair counts in the first key that
both share. Exact counts make this work quadratic inside a group of vectors that are all linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, components, keeps_nothing, saved, table

COSINE = 0.95
RECALL = 0.995
PROBES = 4
BLOCK = 1024
#: Codes of a table for each vector, at least; with them buckets of unrelated vectors stay small at any number.
SPARSENESS = 16


@lru_cache(maxsize=8)
def _sylvester(size: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length is a power of two: butterflies of
    up to 64 values at a time."""
    shape, size = x.shape, x.shape[-1]
    step = min(64, size)
    x = x.reshape(-1, step) @ _sylvester(step)
    while step < size:
        radix = min(64, size // step)
        x = np.matmul(_sylvester(radix), x.reshape(-1, radix, step))
        step *= radix
    return x.reshape(shape)


def hashes_for(count: int, dim: int) -> int:
    """Hashes of a key so that ``count`` vectors have SPARSENESS codes each."""
    codes = 2 * _padded(dim)
    n = 1
    while codes**n < SPARSENESS * count and codes ** (n + 1) < 1 << 57:
        n += 1
    return n


def _padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


@lru_cache(maxsize=64)
def _signs(dim: int, table: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([11, dim, table]).choice([-1.0, 1.0], (hashes, 3, _padded(dim)))


def keys(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Unit vectors (n, dim) to keys (n, tables, probes); a table's probes differ.

    With fewer than ``probes`` choices of axes the last one is repeated.
    """
    n, dim = x.shape
    size = _padded(dim)
    x = np.pad(x, ((0, 0), (0, size - dim)))
    out = np.empty((n, tables, probes), np.int64)
    masks = np.array([[m >> h & 1 for h in range(hashes)] for m in range(1 << hashes)])
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = (np.empty((n, hashes), np.int64), np.empty((n, hashes), np.int64), np.empty((n, hashes)))
        for h, rounds in enumerate(_signs(dim, t, hashes)):
            y = x
            for s in rounds:
                y = hadamard(y * s)
            far = np.abs(y)
            for code, sign in ((first, 1), (second, -1)):  # the two axes nearest to the vector
                at = far.argmax(1)
                code[:, h] = 2 * at + (y[rows, at] < 0)
                loss[:, h] = far[rows, at] if sign == 1 else loss[:, h] - far[rows, at]
                far[rows, at] = -1
        # Probes: sets of hashes that take their second axis, cheapest total loss first.
        order = np.argsort(loss @ masks.T, 1, kind="stable")[:, :probes]
        if order.shape[1] < probes:
            order = np.pad(order, ((0, 0), (0, probes - order.shape[1])), mode="edge")
        key = np.full(order.shape, t, np.int64)
        for h in range(hashes):
            key = key * (2 * size) + np.where(masks[order, h] == 1, second[:, h : h + 1], first[:, h : h + 1])
        out[:, t] = key
    return out


@lru_cache(maxsize=64)
def tables_for(dim: int, hashes: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES) -> int:
    """Tables that find ``recall`` of 4000 simulated pairs at exactly that cosine; nearer pairs are found more often."""
    if dim == 1 or cosine >= 1:
        return 1
    r = np.random.default_rng([5, dim])
    a, b = unit(r.normal(size=(4000, dim))), r.normal(size=(4000, dim))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    b = cosine * a + np.sqrt(1 - cosine * cosine) * b
    p = (keys(a, 1, hashes, probes)[:, 0, :, None] == keys(b, 1, hashes, probes)[:, 0, None, :]).any((1, 2)).mean()
    return int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(p, 1e-3), 0.999))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def labels(linked: np.ndarray) -> np.ndarray:
    """linked: a symmetric boolean matrix. The smallest index that each row reaches."""
    n = len(linked)
    own, left = np.full(n, -1), np.ones(n, bool)
    for i in range(n):
        if left[i]:
            own[i], left[i] = i, False
            front = np.array([i])
            while len(front):
                near = linked[front].any(0) & left
                left &= ~near
                front = np.flatnonzero(near)
                own[front] = i
    return own


def shared_before(key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of two key tables (n, m) share a key smaller than ``key``: (n, n')."""
    both = np.concatenate([left, right])
    known, place, times = np.unique(both, return_inverse=True, return_counts=True)
    use = (times > 1) & (known < key)
    column, place = np.cumsum(use) - 1, place.reshape(both.shape)
    flags = np.zeros((len(both), int(use.sum())), np.float32)
    row, at = np.nonzero(use[place])
    flags[row, column[place[row, at]]] = 1
    return flags[: len(left)] @ flags[len(left) :].T > 0


def verify(key: int, x: np.ndarray, ks: np.ndarray, copies: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's block pair. ks: keys (n, tables * probes). side: 0 and 1 for two blocks, 2 for one against itself.

    Returns for each vector the rows linked to it here first, and the smallest index it reaches.
    """
    n = len(x)
    whole = side[0] == 2
    left = np.arange(n) if whole else np.flatnonzero(side == 0)
    right = left if whole else np.flatnonzero(side == 1)
    s = x[left] @ x[right].T >= cosine
    if whole:
        s &= s.T  # rounding may differ
        np.fill_diagonal(s, False)
    count = np.zeros(n, np.int64)
    if not s.any():
        return count, np.arange(n)
    linked = s
    if not whole:
        linked = np.zeros((n, n), bool)
        linked[np.ix_(left, right)] = s
        linked |= linked.T
    reach = labels(linked)
    a, b = s.any(1), s.any(0)  # only those with a link are looked at further
    new = s[np.ix_(a, b)] & ~shared_before(key, ks[left[a]], ks[right[b]])
    count[left[a]] += (new @ copies[right[b]].astype(float)).astype(np.int64)
    if not whole:
        count[right[b]] += (copies[left[a]].astype(float) @ new).astype(np.int64)
    return count, reach


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls: its bytes, and where each value begins and ends."""
    column = column.cast(pa.large_binary())
    size = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + size + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of ``dim`` doubles each as a matrix."""
    data, offsets = _floats(column)
    return data[offsets[0] : offsets[-1]].view(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _hashed(count: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("vectors")
        for b in batches:
            sizes = np.diff(_floats(b.column(1))[1]) // 8
            for dim in np.unique(sizes).tolist():
                part = pa.Table.from_batches([b]).filter(pa.array(sizes == dim)).combine_chunks()
                hashes = hashes_for(count, dim)
                tables = tables_for(dim, hashes, cosine)
                for at in range(0, part.num_rows, max(16, (1 << 18) // dim)):
                    some = part.slice(at, max(16, (1 << 18) // dim)).combine_chunks()
                    x = _rows_of(some.column(1).chunk(0), dim)
                    k = keys(x, tables, hashes).reshape(len(x), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel()))
                    yield pa.record_batch([some.column(0).chunk(0), pa.array(np.full(len(k), dim, np.int32)), lists], ["cls", "dim", "keys"])

    return run


_MET = "key", "dim", "lo", "hi", "side", "cls", "copies", "vec", "keys"


def _checked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("vectors")
        rest, out = None, []

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            out.clear()
            return pa.record_batch([pa.array(c) for c in columns], ["cls", "other", "links"])

        def judge(b: pa.RecordBatch, cuts: list[int]) -> None:
            """The rows of the block pairs between the cuts."""
            key, dim, side, cls, copies = (b.column(k).to_numpy() for k in (0, 1, 4, 5, 6))
            data, vec_at = _floats(b.column(7))
            flat, keys_at = b.column(8).values.to_numpy(), b.column(8).offsets.to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2 or side[s] < 2 and side[s] == side[e - 1]:  # sorted by side; one block alone
                    continue
                x = data[vec_at[s] : vec_at[e]].view(np.float64).reshape(e - s, dim[s])
                ks = flat[keys_at[s] : keys_at[e]].reshape(e - s, -1)
                n, reach = verify(int(key[s]), x, ks, copies[s:e], side[s:e], cosine)
                met = np.flatnonzero((n > 0) | (reach != np.arange(e - s)))
                if len(met):
                    out.append((cls[s:e][met], cls[s:e][reach[met]], n[met]))

        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            place = np.stack([b.column(k).to_numpy() for k in range(4)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist()]
            judge(b, cuts)
            rest = b.slice(cuts[-1])
            if len(out) > 1000:
                yield batch()
        if rest is not None:
            judge(rest, [0, rest.num_rows])
        yield batch()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing;
    so do vectors of different length with each other. Every row is a vector of its own: rows that
    repeat an id, or lack one, link by their vectors alone, and equal vectors, which are compared
    once, are links of each other. component_id is the smallest id reachable, null where no row of
    the component has one; kept says whether it is the row's own. Other columns are ignored, and an
    empty table gives an empty result. A vector of any length is hashed and compared whole.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.transform("embedding", lambda x: x + F.lit(0.0))))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("vectors")
        for b in batches:
            lists = b.column(1)
            sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            out: list = [None] * len(sizes)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = unit(flat[(ends[rows] - dim)[:, None] + np.arange(dim)])
                for i, value in zip(rows.tolist(), x):
                    out[i] = value.tobytes()
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = saved(v.mapInArrow(normal, "vec_id long, vec binary"), "vectors")
    usable = rows.where("vec is not null")
    # A class is a distinct vector; its number is unique and fixed by being written.
    classes = usable.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    hashed = classes.select("cls", "vec").mapInArrow(_hashed(classes.count(), cosine), "cls long, dim int, keys array<long>")
    hashed = saved(hashed, "hashed")
    each = hashed.select("cls", "dim", F.explode(F.array_distinct("keys")).alias("key"))
    each = block_pairs(each, ["key", "dim"], "cls", block)
    met = each.join(classes, "cls").join(hashed.select("cls", "keys"), "cls").select(*_MET)
    met = met.repartition("key", "dim", "lo", "hi").sortWithinPartitions("key", "dim", "lo", "hi", "side")
    found = saved(met.mapInArrow(_checked(cosine), "cls long, other long, links long"), "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.where("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    per = classes.join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    per = per.withColumn("component", F.coalesce("component", "cls")).select("vec", "least", "copies", "component", F.coalesce("links", F.lit(0)).alias("links"))
    per = saved(per, "linked")
    least = saved(per.groupBy("component").agg(F.min("least").alias("group")), "least")
    per = saved(per.join(least, "component").select("vec", "group", (F.col("copies") - 1 + F.col("links")).alias("links")), "groups")
    own = F.col("vec_id").eqNullSafe(F.col("group"))
    linked = usable.join(per, "vec").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("group").alias("component_id"), own.alias("kept"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
