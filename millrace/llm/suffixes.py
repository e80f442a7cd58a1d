"""Removal of byte strings that occurred before, by hash-compared suffix sorting.

1. Every window of ``LENGTH`` bytes is assigned to the 32-byte string in it whose hash is smallest
   (the leftmost of equals): its anchor. Equal windows have equal anchors at equal distances, so
   anchors are the buckets of the suffix sort. The stretch of text whose windows share an anchor is
   its context. In a map task contexts that repeat within some megabytes are compared byte by byte
   and folded, so that a task sends a context once however often it occurs, and one row for an
   anchor to find out whether other tasks hold it too; anchors that occur once are dropped.
2. All contexts of the other anchors are fetched as bytes. The suffixes that start at equal distance
   from an anchor are sorted by a merge sort that compares them through prefix polynomial hashes:
   binary search over the hashes finds the common extension, and the next byte decides. Neighbours
   that agree on ``LENGTH`` bytes are verified byte by byte; all but the earliest are repeats.
   Of contexts with the same bytes only the first is sorted, the others repeat it.
   The windows of an anchor with more than ``cap`` contexts, which differ between map tasks or are
   very many, are not sorted: of each window's bytes the earliest place is found by an aggregate
   that map tasks begin. These places go to their documents, whose other windows of such contexts
   are repeats. No task gets all windows, and repeats are never rows of their own.
3. The repeats of each document are merged and cut out.

Work and data moved are linear in the text: about one row of four numbers for 35 bytes, and the
bytes of contexts that occur in several tasks. Long texts are taken in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_nothing, numbered, saved, table, text_bytes

LENGTH = 100
ANCHOR = 32
#: Window starts of a text that are looked at together, and text that is folded together.
PIECE, FOLDED = 1 << 19, 12 << 20
#: Contexts of an anchor beyond which its windows are dealt out, and windows of whole documents that
#: are then held against the first ones together.
CAP, WINDOWS = 2000, 1 << 20
_U = np.uint64
BASE, BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 17)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (self.base, self.inverse))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Hash of every prefix; that of data[i:j] is (prefix[j] - prefix[i]) * down[i]."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum((data + _U(1)) * self.up[: len(data)], out=out[1:])
        return out


_P, _P2 = Powers(BASE), Powers(BASE2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its smallest, the leftmost of equals."""
    value, index, size = x, np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        a, b = value[:-step], value[step:]
        left = a <= b
        value, index = np.where(left, a, b), np.where(left, index[:-step], index[step:])
        size += step
    return index


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Of one text: anchor hash, context hash, anchor position, windows to its left and right."""
    if len(text) < LENGTH:
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int32),) + (np.zeros(0, np.int16),) * 2
    data = np.frombuffer(text, np.uint8).astype(_U)
    p, p2 = _P.prefixes(data), _P2.prefixes(data)
    n = len(data)
    h = mix((p[ANCHOR:] - p[: n - ANCHOR + 1]) * _P.down[: n - ANCHOR + 1])
    at = leftmost_minima(h, LENGTH - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    m = at[first]
    c = (p2[last + LENGTH] - p2[first]) * _P2.down[first]
    c = mix(c + (m - first).astype(_U) * _U(0xA24BAED4963EE407) + (last - m + LENGTH).astype(_U) * _U(0x9FB21C651E98DF25))
    return h[m], c, m.astype(np.int32), (m - first).astype(np.int16), (last - m).astype(np.int16)


def _pack(at, left, right):
    """Position, windows to the left (0..68) and to the right (-68..0) in one number."""
    return (at << 14) | (left << 7) | (right + LENGTH - ANCHOR)


def _unpack(x):
    return x >> 14, (x >> 7) & 127, (x & 127) - (LENGTH - ANCHOR)


def merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, overlapping or adjacent ones joined."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    number = np.cumsum(np.r_[0, rid[1:] != rid[:-1]])
    far = int(max(end.max(), 1)) + 1
    reach = np.maximum.accumulate(end + number * far)
    new = np.r_[True, (start[1:] + number[1:] * far > reach[:-1]) | (rid[1:] != rid[:-1])]
    begin = np.flatnonzero(new)
    return rid[begin], start[begin], np.maximum.reduceat(end, begin)


_ROW = "key long, rid long, at long, x long"
_EXTRA = 1 << 62


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that overlap, so that each window starts in one."""
    for s in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield s, text[s : s + PIECE + LENGTH - 1] if len(text) > PIECE else text


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of the same sizes that begin at a and b hold the same bytes."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 4000):
        n = size[k : k + 4000]
        end = np.cumsum(n)
        step = np.arange(int(end[-1])) - np.repeat(end - n, n)
        same = data[np.repeat(a[k : k + 4000], n) + step] == data[np.repeat(b[k : k + 4000], n) + step]
        out[k : k + 4000] = np.logical_and.reduceat(same, end - n)
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts, by blocks of some megabytes, in three kinds of rows. Repeats within the
    block: at < 0, the span is -1 - at to x. The first context of an anchor: x says whether the block
    has others. These others: at has _EXTRA, x is the anchor, and key only deals them out."""

    def close(held: list) -> pa.RecordBatch:
        rids, offsets, blocks, parts = zip(*held)
        held.clear()
        own = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        h, c, m, left, right = (np.concatenate(x) for x in zip(*parts))
        del parts
        left, right = left.astype(np.int64), right.astype(np.int64)
        rid, m = np.array(rids, np.int64)[own], m + np.array(offsets, np.int64)[own]
        shift = np.cumsum([0, *map(len, blocks)])[:-1] - np.array(offsets, np.int64)  # from a text's places to those in data
        order = np.lexsort((m, rid, c, h))
        h, c, m, left, right, rid, own = (x[order] for x in (h, c, m, left, right, rid, own))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        if again.any():
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            rows = np.flatnonzero(again)
            one = first[rows]
            same = (left[rows] == left[one]) & (right[rows] == right[one])
            rows, one = rows[same], one[same]
            data = np.frombuffer(b"".join(blocks), np.uint8)
            place = m - left + shift[own]
            again[:] = False
            again[rows] = equal_bytes(data, place[rows], place[one], (left + right + LENGTH)[rows])
        r, s, e = merged(rid[again], (m - left)[again], (m + right + LENGTH)[again])
        new = ~again
        key, rid, at = h[new].view(np.int64), rid[new], _pack(m, left, right)[new]
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        several = np.zeros(len(key), np.int64)
        several[np.flatnonzero(head)[np.cumsum(head)[~head] - 1]] = 1
        extra = ~head
        columns = [
            np.concatenate([key[head], mix((rid[extra] ^ at[extra]).astype(_U)).view(np.int64), mix(r.astype(_U)).view(np.int64)]),
            np.concatenate([rid[head], rid[extra], r]),
            np.concatenate([at[head], at[extra] | _EXTRA, -1 - s]),
            np.concatenate([several[head], key[extra], e]),
        ]
        return pa.record_batch([pa.array(x) for x in columns], ["key", "rid", "at", "x"])

    keeps_nothing("suffixes")
    held, size = [], 0
    for b in batches:
        for rid, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            for offset, piece in pieces(text):
                held.append((rid, offset, piece, anchors(piece)))
                size += len(piece)
                if size > FOLDED:
                    yield close(held)
                    size = 0
    if held:
        yield close(held)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key. Repeats as (null, rid, start, end); contexts of anchors that have several
    as (key, rid, at, 0). Anchors with one context are dropped."""

    def out(key, rid, x, y):
        arrays = [pa.array(key, pa.int64()), *(pa.array(np.asarray(z, np.int64)) for z in (rid, x, y))]
        return pa.record_batch(arrays, ["key", "rid", "x", "y"])

    keeps_nothing("suffixes")
    last = np.zeros((0, 4), np.int64)  # the latest anchor's only row so far
    open_: int | None = None  # the latest anchor, if it has several
    for b in batches:
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
        done, extra = rows[:, 2] < 0, rows[:, 2] >= _EXTRA
        if done.any():
            d = rows[done]
            yield out([None] * len(d), d[:, 1], -1 - d[:, 2], d[:, 3])
        if extra.any():
            d = rows[extra]
            yield out(d[:, 3], d[:, 1], d[:, 2] ^ _EXTRA, np.zeros(len(d)))
        rows = np.concatenate([last, rows[~done & ~extra]])
        if not len(rows):
            continue
        begin = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        size = np.diff(np.r_[begin, len(rows)])
        several = (size > 1) | (np.maximum.reduceat(rows[:, 3], begin) > 0)
        if open_ is not None and rows[0, 0] == open_:
            several[0] = True
        chosen = rows[np.repeat(several, size)]
        if len(chosen):
            yield out(chosen[:, 0], chosen[:, 1], chosen[:, 2], np.zeros(len(chosen)))
        last = rows[:0] if several[-1] else rows[-1:]
        open_ = int(rows[-1, 0]) if several[-1] else None


class Suffixes:
    """Suffixes of some bytes, compared over ``LENGTH`` bytes through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.p = _P.prefixes(data.astype(_U))

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        return (self.p[at + n] - self.p[at]) * _P.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most LENGTH, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        whole = self.hashes(a, LENGTH) == self.hashes(b, LENGTH)
        low[whole] = LENGTH
        todo = np.flatnonzero(~whole)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            equal = self.hashes(a[todo], mid) == self.hashes(b[todo], mid)
            low[todo[equal]], high[todo[~equal]] = mid[equal], mid[~equal]
            todo = todo[high[todo] - low[todo] > 1]
        return low

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a comes before b; equal ones by ``ties``."""
        n = self.common(a, b)
        end = n == LENGTH
        n = np.where(end, 0, n)
        return np.where(end, ties, self.data[a + n] < self.data[b + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes within each group; group ascending, equal suffixes keep their order.

        Merge sort of all groups at once: each element finds its place in the neighbouring run by
        binary search.
        """
        n = len(at)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, n])
        base, own = np.repeat(first, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while width < size.max(initial=0):
            e = np.flatnonzero(own > width)
            place = e - base[e]
            run = place // width
            right = run & 1 == 1
            other = (run ^ 1) * width
            low = np.minimum(other, own[e])
            high = np.minimum(other + width, own[e])
            start, mine = low.copy(), at[order[e]]
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) // 2
                theirs = at[order[base[e[todo]] + mid]]
                # In the neighbour run, those before me: on the left equal ones too.
                up = self.less(theirs, mine[todo], right[todo])
                low[todo[up]] = mid[up] + 1
                high[todo[~up]] = mid[~up]
                todo = todo[low[todo] < high[todo]]
            target = base[e] + (run & ~1) * width + place - run * width + (low - start)
            new = order.copy()
            new[target] = order[e]
            order = new
            width *= 2
        return order

    def repeats(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which suffixes agree over LENGTH bytes with one before them in their group."""
        out = np.zeros(len(at), bool)
        order = self.sort(at, group)
        a, b = order[:-1], order[1:]
        same = (group[a] == group[b]) & (self.hashes(at[a], LENGTH) == self.hashes(at[b], LENGTH))
        pairs = np.flatnonzero(same)
        reach = np.arange(LENGTH)
        for k in range(0, len(pairs), 20_000):
            part = pairs[k : k + 20_000]
            equal = (self.data[at[a[part]][:, None] + reach] == self.data[at[b[part]][:, None] + reach]).all(1)
            out[b[part]] = True
            for bad in set(group[a[part[~equal]]].tolist()):  # a collision: compare that group's bytes
                known: set = set()
                for i in np.flatnonzero(group == bad).tolist():
                    value = self.data[at[i] : at[i] + LENGTH].tobytes()
                    out[i] = value in known
                    known.add(value)
        return out


def windows(bucket: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of contexts laid end to end, ascending in bucket: each window's context, place, and (bucket,
    distance) group, only groups of two or more, in the order of group and context."""
    count = left + right + 1
    start = np.cumsum(size) - size
    ctx = np.repeat(np.arange(len(bucket)), count)
    inside = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    group = bucket[ctx] * 128 + inside - left[ctx] + 100
    many = np.bincount(group, minlength=0)[group] > 1
    ctx, inside, group = ctx[many], inside[many], group[many]
    order = np.argsort(group, kind="stable")
    return ctx[order], (start[ctx] + inside)[order], group[order]


_CTX = "key long, rid long, at long, bytes binary"


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key, rid, at: the windows among them that occurred before. A key has no more
    than ``cap`` contexts."""

    def close(rows):
        known: set = set()
        new = [(k := (key, packed & 0x3FFF, value)) not in known and not known.add(k) for key, _, packed, value in rows]
        new = np.array(new)
        key, rid, packed = (np.array(x, np.int64) for x in list(zip(*rows))[:3])
        at, left, right = _unpack(packed)
        whole = rid[~new], (at - left)[~new], (at + right + LENGTH)[~new]  # bytes equal to an earlier context's
        rows = [row for row, n in zip(rows, new.tolist()) if n]
        key, rid, at, left, right = (x[new] for x in (key, rid, at, left, right))
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        ctx, place, group = windows(bucket, left, right, size)
        start = np.cumsum(size) - size
        again = Suffixes(data).repeats(place, group)
        ctx, place = ctx[again], place[again]
        s = at[ctx] - left[ctx] + place - start[ctx]
        r, s, e = merged(*(np.concatenate(x) for x in zip((rid[ctx], s, s + LENGTH), whole)))
        return pa.record_batch([pa.array(x) for x in (r, s, e)], ["rid", "x", "y"])

    keeps_nothing("suffixes")
    rows: list = []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(4))):
            if len(rows) >= 4000 and row[0] != rows[-1][0]:
                yield close(rows)
                rows = []
            rows.append(row)
    if rows:
        yield close(rows)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(text, rid, list of (key, at)): of each text its bytes, rid, keys, packed places, and where the
    contexts begin and end."""
    keeps_nothing("suffixes")
    for b in batches:
        for k in range(b.num_rows):
            asked = b.column(2)[k].values
            packed = asked.field(1).to_numpy()
            at, left, right = _unpack(packed)
            yield (b.column(0)[k].as_py() or "").encode(), b.column(1)[k].as_py(), asked.field(0).to_pylist(), packed.tolist(), (at - left).tolist(), (at + right + LENGTH).tolist()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context that is asked for, with its bytes."""

    def batch(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()])], ["key", "rid", "at", "bytes"])

    out: list = []
    for text, rid, keys, packed, begin, end in _asked(batches):
        for key, x, s, e in zip(keys, packed, begin, end):
            out.append((key, rid, x, text[s:e]))
            if len(out) >= 20_000:
                yield batch(out)
    yield batch(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the contexts that are asked for, with its bytes."""

    def batch(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 3
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["rid", "x", "bytes"])

    out: list = []
    for text, rid, _, _, begin, end in _asked(batches):
        for s, e in zip(begin, end):
            out += [(rid, w, text[w : w + LENGTH]) for w in range(s, e - LENGTH + 1)]
            if len(out) >= 20_000:
                yield batch(out)
    yield batch(out)


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document (rid, packed places of contexts, places of windows that no other comes before):
    the spans of all other windows of these contexts."""
    keeps_nothing("suffixes")
    for b in batches:
        rid, of = b.column(0).to_numpy(), np.arange(b.num_rows)
        at, left, right = _unpack(b.column(1).flatten().to_numpy())
        ctx, first = (np.repeat(of, b.column(k).value_lengths().to_numpy()) for k in (1, 2))
        x, count = b.column(2).flatten().to_numpy(), left + right + 1
        part = np.cumsum(np.bincount(ctx, count, len(of))) // WINDOWS  # documents that are looked at together
        for k in np.unique(part):
            own = np.flatnonzero(part[ctx] == k)
            n = count[own]
            place = np.arange(n.sum()) + np.repeat((at - left)[own] - np.cumsum(n) + n, n)
            row, mine = np.repeat(ctx[own], n), part[first] == k
            far = max(place.max(initial=0), x.max(initial=0)) + 1
            again = ~np.isin(row * far + place, first[mine] * far + x[mine])
            r, s, e = merged(row[again], place[again], place[again] + LENGTH)
            yield pa.record_batch([pa.array(c) for c in (rid[r], s, e)], ["rid", "x", "y"])


def _crowded_repeats(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Spans of windows that occurred before, for anchors with many contexts: places (rid, c)."""
    asked = places.groupBy("rid").agg(F.collect_list("c").alias("asked"))  # a document's own
    found = docs.join(asked, "rid").select("text", "rid", "asked").mapInArrow(_windows, "rid long, x long, bytes binary")
    first = found.groupBy("bytes").agg(F.min(F.struct("rid", "x")).alias("f")).select("f.rid", F.lit(None).cast("long").alias("place"), F.col("f.x").alias("first"))
    both = places.select("rid", F.col("c.x").alias("place"), F.lit(None).cast("long").alias("first")).unionByName(first)
    own = both.groupBy("rid").agg(F.collect_list("place"), F.collect_list("first"))  # a document's own
    return own.mapInArrow(_not_first, "rid long, x long, y long")


def repeats(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """docs: (text, __row). Byte spans (rid, x, y) to remove; they may overlap."""
    docs = docs.withColumnRenamed("__row", "rid")
    seen = docs.select("rid", "text").mapInArrow(_seen, _ROW)
    rows = seen.repartition("key").sortWithinPartitions("key")
    got = saved(rows.mapInArrow(_first, "key long, rid long, x long, y long"), "contexts")
    whole, open_ = got.where("key is null").select("rid", "x", "y"), got.where("key is not null")
    crowded = open_.groupBy("key").count().where(F.col("count") > cap).select("key", F.lit(True).alias("hot"))
    crowded = saved(crowded, "crowded")
    open_ = open_.join(crowded, "key", "left").select("rid", "hot", F.struct("key", "x").alias("c"))
    asked = open_.where("hot is null").groupBy("rid").agg(F.collect_list("c").alias("asked"))  # a document's own
    ctx = docs.join(asked, "rid").select("text", "rid", "asked").mapInArrow(_contexts, _CTX)
    dealt = ctx.repartition("key").sortWithinPartitions("key", "rid", "at")
    out = whole.unionByName(saved(dealt.mapInArrow(_sorted_out, "rid long, x long, y long"), "sorted"))
    if crowded.isEmpty():
        return out
    return out.unionByName(saved(_crowded_repeats(docs, open_.where("hot").select("rid", "c")), "crowded"))


def kept_bytes(text: bytes, starts: list[int], ends: list[int]) -> tuple[bytes, int, int]:
    """What remains of a text without the spans, the bytes removed and the maximal runs of them."""
    if not starts:
        return text, 0, 0
    n = len(starts)
    _, s, e = merged(np.zeros(n, np.int64), np.array(starts), np.array(ends))
    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, len(text) - len(kept), len(s)


def _with_spans(docs: DataFrame, cap: int) -> DataFrame:
    """docs and the spans to remove: every column, __starts, __ends."""
    d = numbered(docs)
    spans = repeats(d.select("text", "__row"), cap).groupBy(F.col("rid").alias("__row"))
    spans = spans.agg(F.collect_list("x").alias("__starts"), F.collect_list("y").alias("__ends"))  # a document's own
    return d.join(spans, "__row", "left").drop("__row")


def cut_texts(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Every column of ``docs``, its texts without the repeats, and n_removed, the bytes cut out.

    Null texts stay null. What a cut leaves of a character is dropped. A column n_removed of the
    input is replaced; __row, __starts and __ends are the operator's own names. Repeated and null
    ids, long texts and empty tables are taken as in ``deduplicate``.
    """
    d = _with_spans(docs.drop("n_removed"), cap)
    at, names = d.columns.index("text"), [c for c in d.columns if c not in ("__starts", "__ends")]
    schema = d.select(*names, F.lit(0).cast("long").alias("n_removed")).schema
    spans = [d.columns.index(c) for c in ("__starts", "__ends")]
    rest = [d.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, ends = b.column(at).cast(pa.binary()).to_pylist(), *(b.column(k).to_pylist() for k in spans)
            got = [(None, 0, 0) if t is None else kept_bytes(t, x, y) for t, x, y in zip(texts, starts, ends)]
            columns = [b.column(k) for k in rest]
            columns[names.index("text")] = pa.array([None if x[0] is None else x[0].decode("utf-8", "ignore") for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in got], pa.int64())], names=schema.names)

    return d.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row of ``docs`` (doc_id, text).

    Null texts are empty; texts under ``LENGTH`` bytes lose nothing. Rows that share a doc_id count
    as documents of their own, in the order of their texts' hashes, and rows without one come first.
    A long text is read in pieces of ``PIECE`` bytes, each with all windows that start in it. Other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            got = [kept_bytes(t, s, e) for t, s, e in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())]
            sizes = ([len(t) for t in texts], [x[1] for x in got], [x[2] for x in got])
            columns = [pa.array([x[0] for x in got], pa.binary()), *(pa.array(x, pa.int64()) for x in sizes)]
            yield pa.record_batch([b.column(0), *columns], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    d = _with_spans(docs.select("doc_id", "text"), cap).select("doc_id", "text", "__starts", "__ends")
    return d.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = deduplicate(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
