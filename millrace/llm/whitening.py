"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers x = floor(1024 c) + OFFSET. Tasks subtract a shift, the offset, from x and
sum the small numbers that are left and their products without rounding: numbers are taken apart
into limbs so short that a product of limb matrices is exact in double precision, and put together
as integers of any length. Spark adds the tasks' sums, each in two parts that a decimal holds. From
n, the sums S and the products XᵀX the scatter n·XᵀX − SSᵀ is formed in integers, which the shift
leaves as it is; only this is turned into floating point and decomposed.

What the driver takes is one number for each pair of dimensions. Vectors are read once to find the
commonest length and once for each of sums, check and result; none of them is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Rows that a task multiplies at a time.
BLOCK = 8192
#: Entries beyond it, where scaled integers would leave the long range, are taken as this large.
WIDEST = 1 << 62
_LIMB = 20
_PART = 10**18

SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def _vectors(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that take part: ids, and the entries of all vectors with where each begins and ends."""
    lists = batch.column(1).cast(pa.list_(pa.float64()))
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries become nan
    offsets = lists.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sound = ~lists.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return batch.column(0).filter(pa.array(sound)), values, offsets[:-1][sound], offsets[1:][sound]


def _integers(values: np.ndarray) -> np.ndarray:
    """x - OFFSET of entries."""
    scaled = np.floor(SCALE * values)
    out = np.clip(scaled, -float(WIDEST), float(WIDEST)).astype(np.int64)
    return out


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Blocks of the vectors of one length: ids, and x - OFFSET as rows of int64."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            ids, values, first, past = _vectors(b.slice(at, BLOCK))
            fits = past - first == width
            ids, first = ids.filter(pa.array(fits)), first[fits]
            if len(first):
                yield ids, _integers(values[first[:, None] + np.arange(width)])


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles of at most _LIMB bits and sign that add up to y when each is shifted by as many more bits."""
    out, top = [], 1 << (_LIMB - 1)
    while True:
        low = ((y + top) & ((1 << _LIMB) - 1)) - top
        out.append(low.astype(np.float64))
        y = (y - low) >> _LIMB
        if not y.any():
            return out


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and products YᵀY of integers, as Python integers: a block has at most 2^13 rows, so
    sums of products of limbs stay below 2^52 and are exact as doubles."""
    limbs = _limbs(y)
    sums, products = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
    for a, left in enumerate(limbs):
        sums += left.sum(0).astype(np.int64).astype(object) << (_LIMB * a)
        for b, right in enumerate(limbs):
            products += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (a + b))
    return sums, products


def common_width(vectors: DataFrame) -> int:
    """The length that most vectors have which take part, the larger of two as frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, first, past = _vectors(b)
            w, n = np.unique(past - first, return_counts=True)
            yield pa.record_batch([pa.array(w.astype(np.int32)), pa.array(n)], ["w", "n"])

    first = vectors.mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    return first.w if first else 0


@dataclass(frozen=True)
class Model:
    n: int
    width: int
    sums: tuple  # of x - OFFSET
    components: np.ndarray  # a column each
    values: np.ndarray  # eigenvalues, falling
    trace: float


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of x - OFFSET, and n·XᵀX − SSᵀ, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for ids, y in _matrices(batches, width):
            n += len(y)
            s, p = exact_sums(y)
            sums, products = sums + s, products + p
        if n:
            rows = [(-1, -1, n)] + [(-1, i, int(sums[i])) for i in range(width)] + [(i, j, int(products[i, j])) for i in range(width) for j in range(i, width)]
            i, j, v = zip(*rows)
            high, low = zip(*(divmod(x, _PART) for x in v))
            number = pa.decimal128(38, 0)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, high), number), pa.array(map(Decimal, low), number)], ["i", "j", "high", "low"])

    # A number's parts grow by the number of tasks: far within 38 digits.
    added = vectors.mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))
    got = {(r.i, r.j): int(r.high) * _PART + int(r.low) for r in added.collect()}  # one for each pair of dimensions
    n, sums = got.get((-1, -1), 0), [got.get((-1, i), 0) for i in range(width)]
    out = np.zeros((width, width), object)
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = n * got.get((i, j), 0) - sums[i] * sums[j]
    return n, sums, out


def fit(vectors: DataFrame) -> Model:
    """The model of vectors (vec_id, embedding)."""
    width = common_width(vectors)
    n, sums, integers = scatter(vectors, width) if width else (0, [], np.zeros((0, 0), object))
    covariance = np.array([[x / (n * n) for x in row] for row in integers], float).reshape(width, width)  # each division is rounded once
    values, components = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    trace = sum(integers[i, i] for i in range(width)) / (n * n) if n else 0.0
    return Model(n, width, tuple(sums), components[:, ::-1][:, :COMPONENTS].copy(), values[::-1][:COMPONENTS].copy(), trace)


def _scales(model: Model) -> np.ndarray:
    """1 / sqrt(e); nan where the variance is none within double precision."""
    none = model.values <= model.trace * model.width * np.finfo(float).eps
    return np.where(none, np.nan, 1 / np.sqrt(np.where(none, 1, model.values)))


def _whitened(model: Model, y: np.ndarray) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums])
    return (y - mean) @ model.components * _scales(model)


def _deviations(model: Model, y: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact: in limbs, where 64 bits may not do."""
    shift = np.array([-(-s // model.n) for s in model.sums], object)  # n (x - shift) + rest, both small
    rest = np.array([model.n * int(m) - s for m, s in zip(shift, model.sums)], object)
    largest = max((int(np.abs(y).max(initial=0)) + int(np.abs(shift).max(initial=0))) * model.n + int(np.abs(rest).max(initial=0)), 1)
    if largest**2 * model.width < 1 << 63:
        d = (y - shift.astype(np.int64)) * model.n + rest.astype(np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = (y.astype(object) - shift) * model.n + rest
    return (d * d).sum(1).tolist()


def identity_error(vectors: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components that
    have a variance. Tasks centre their rows by their own means, whose differences are then added."""
    k = model.components.shape[1]
    names = ["n", "means", "products"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y in _matrices(batches, model.width):
            w = _whitened(model, y)
            mean = w.mean(0)
            centred = w - mean
            row = [[len(w)], [mean.tolist()], [(centred.T @ centred).ravel().tolist()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names)

    if not model.n or not k:
        return None
    blocks = saved(vectors.mapInArrow(run, "n long, means array<double>, products array<double>"), "moments")
    mean = blocks.agg(*[F.sum(F.col("n") * F.get("means", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    mean = [m / model.n for m in mean]
    off = lambda i: F.get("means", F.lit(i)) - F.lit(mean[i])
    total = blocks.agg(*[F.sum(F.get("products", F.lit(i * k + j)) + F.col("n") * off(i) * off(j)).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    error = np.abs(np.array(list(total), float).reshape(k, k) / model.n - np.eye(k))
    have = np.isfinite(_scales(model))
    return float(error[have][:, have].max()) if have.any() else None


def whiten(vectors: DataFrame) -> DataFrame:
    """RESULT for each vector that takes part and each of up to COMPONENTS components.

    vectors: vec_id, embedding; other columns are ignored. Rows without a vector, and those with a
    null or non-finite entry, take no part, nor do vectors of another length than the commonest one.
    Repeated and null ids are rows of their own. A component without variance (fewer rows or
    dimensions than components) has null for whitened; an empty table gives an empty result.
    deviation is null where it is beyond a long: deviation_text then has its digits.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    model = fit(v)
    error, k = identity_error(v, model), model.components.shape[1]
    explained = model.values / model.trace if model.trace else np.full(k, np.nan)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y in _matrices(batches, model.width) if k else ():
            m, deviation = len(y), _deviations(model, y)
            long = [d if d < 1 << 63 else None for d in deviation]
            text = [None if d < 1 << 63 else str(d) for d in deviation]
            each = pa.array(np.repeat(np.arange(m), k))
            w, e = _whitened(model, y).ravel(), np.tile(explained, m)
            yield pa.record_batch(
                [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(long, pa.int64()).take(each),
                    pa.array(w, mask=np.isnan(w)), pa.array(e, mask=np.isnan(e)), pa.array([error] * (m * k), pa.float64()), pa.array(text, pa.string()).take(each),
                ],
                schema=schema,
            )

    return v.mapInArrow(run, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
