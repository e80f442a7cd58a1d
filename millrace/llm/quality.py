"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE_BYTES`` bytes, cut at white space; a text of more
than ``BLOCK_BYTES`` bytes is cut there as well. Each passage is encoded from its bytes and words, and
from its hashed letter trigrams, also those across words, so that what the letters spell counts as well
as how the text looks. The encoding passes a hidden layer, gated attention weights
softmax(w . (tanh(V h) * sigmoid(U h))) are learnt from document labels alone, and the weighted sum of
the passages is scored. All of it is vectorised over the passages of many documents, and the softmax
sums are carried from block to block, so that a text of any length has passages of one size and
bounded memory. Training takes documents in small batches; what it holds of a passage is a byte for
each hashed trigram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_nothing, remainder, table, text_bytes

PASSAGE_BYTES = 400
BLOCK_BYTES = 1_000_000
#: Passages of a document that are learnt from, evenly spread over it.
MAX_TRAIN_PASSAGES = 32
THRESHOLD = 0.3

_KINDS = ["lower", "upper", "digit", "space", "newline", "bar", "shout", "symbol", "stop", "comma", "bracket", "quote", "other", "high"]


def _kinds() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), np.uint8)
    for name, chars in {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n",
        "bar": b"|/\\_", "shout": b"!?", "symbol": b"#$%&*+=@^~", "stop": b".", "comma": b",;:", "bracket": b"()[]{}<>", "quote": b"\"'`-",
    }.items():
        out[list(chars)] = _KINDS.index(name)
    out[128:] = _KINDS.index("high")
    return out


_KIND = _kinds()
_RANDOM = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(8).integers(1, 2**63, 64).astype(np.uint64) | np.uint64(1)
#: Features of a passage's look, and hashed trigrams.
N_LOOKS, N_GRAMS = len(_KINDS) + 10, 1024
N_FEATURES = N_LOOKS + N_GRAMS


def _classes() -> np.ndarray:
    """A byte as one of 32 letters: a to z without case, white space, digits, punctuation, three of other bytes."""
    out = np.full(256, 28, np.uint32)
    for k in range(26):
        out[[97 + k, 65 + k]] = k
    out[list(b" \t\r\n\x0b\x0c")], out[48:58], out[128:] = 26, 27, 29 + np.arange(128) % 3
    return out


_CLASS = _classes()
_GRAM = ((np.arange(1 << 15, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)  # of three letters, a bucket


def _grams(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Passages x hashed trigrams, how often each occurs, at most 255."""
    out = np.zeros((len(cuts) - 1, N_GRAMS), np.uint8)
    for k in range(0, len(out), 256):  # passages at a time, as counts are large before they are cut to a byte
        size = np.diff(cuts[k : k + 257])
        c = _CLASS[b[cuts[k] : cuts[min(k + 256, len(out))] + 2]]  # and the two letters after them
        gram = _GRAM[(c[:-2] << 10) | (c[1:-1] << 5) | c[2:]]
        own = np.repeat(np.arange(len(size)), size)[: len(gram)]
        out[k : k + 256] = np.minimum(np.bincount(own * N_GRAMS + gram[: len(own)], minlength=len(size) * N_GRAMS), 255).reshape(-1, N_GRAMS)
    return out


def dense(looks: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Features of passages: looks, and square roots of the trigrams' shares, less of those of short
    passages; they weigh half of what the looks do."""
    total = grams.sum(1, dtype=np.int64)[:, None] + 100
    return np.concatenate([looks, np.sqrt(grams / total.astype(np.float32)) / 2], axis=1, dtype=np.float32)


def encode(text: bytes) -> np.ndarray:
    """Passages x features of one block of text (one row of zeros if it is blank)."""
    return dense(*encoded(text))


def encoded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same as looks and trigram counts."""
    b = np.frombuffer(text, np.uint8)
    kind = _KIND[b]
    blank = (kind == 3) | (kind == 4)
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros((1, N_LOOKS), np.float32), np.zeros((1, N_GRAMS), np.uint8)
    own = starts // PASSAGE_BYTES  # the passage of each word
    own = np.cumsum(np.r_[0, np.diff(own) > 0])
    n = int(own[-1]) + 1
    first = np.flatnonzero(np.r_[True, np.diff(own) > 0])
    cuts = np.r_[0, starts[first[1:]], len(b)]
    lengths = np.diff(cuts)
    hist = np.bincount(np.repeat(np.arange(n), lengths) * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1)
    sizes = ends - starts
    word_of = np.repeat(np.arange(len(starts)), sizes)
    inside = np.flatnonzero(~blank)
    place = inside - starts[word_of]
    hashes = np.add.reduceat(_RANDOM[b[inside]] * _PLACE[place & 63], np.r_[0, np.cumsum(sizes)[:-1]])
    words = np.bincount(own, minlength=n)
    order = np.lexsort((hashes, own))
    h, o = hashes[order], own[order]
    distinct = np.bincount(o[np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]], minlength=n)
    again = np.bincount(own[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])], minlength=n)
    last, lead = kind[ends - 1], kind[starts]
    bits = np.log1p(sizes)
    f = [
        distinct / words, again / words, np.log1p(words), np.bincount(own, sizes, n) / words / 10,
        np.bincount(own, bits, n) / words, np.bincount(own, last == 7, n) / words, np.bincount(own, last == 6, n) / words,
        np.bincount(own, sizes == 1, n) / words, np.bincount(own, lead == 1, n) / words, np.minimum(np.bincount(own, bits * bits, n) / words - (np.bincount(own, bits, n) / words) ** 2, 4),
    ]
    return np.column_stack([hist / lengths[:, None], *f]).astype(np.float32), _grams(b, cuts)


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks, one at least."""
    for s in range(0, max(1, len(text)), BLOCK_BYTES):
        yield text[s : s + BLOCK_BYTES] if len(text) > BLOCK_BYTES else text


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by mean and spread of those learnt from; what lies far outside of these is held at a bound."""
    return np.clip((x - mean) / scale, -20, 20)


class Model:
    """Gated attention over passages; weights are a few thousand numbers whatever the corpus."""

    def __init__(self, mean, scale, w, prior):
        self.mean, self.scale, self.w, self.prior = mean, scale, w, prior

    @staticmethod
    def encoded(w, x):
        """Of passages: hidden layer, the two gates, and the score that attention weights come from."""
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        return h, t, g, (t * g) @ w["a"]

    @staticmethod
    def decided(w, z):
        return 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))

    @staticmethod
    def forward(w, x, own, n):
        h, t, g, s = Model.encoded(w, x)
        top = np.full(n, -np.inf)
        np.maximum.at(top, own, s)
        e = np.exp(s - top[own])
        att = e / np.bincount(own, e, n)[own]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, own, att[:, None] * h)
        return h, t, g, att, z, Model.decided(w, z)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """bags: all passages of each document."""
        return self.score_blocks(len(bags), enumerate(bags))

    def score_blocks(self, n: int, parts: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
        """parts: (document, passages), as many a document as it has blocks. Only sums are held:
        for each document the largest attention score, and relative to it the weights and weighted
        encodings so far."""
        if self.w is None:
            return np.full(n, self.prior)
        size = len(self.w["c"])
        top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, size))

        def add(own: list[int], bags: list[np.ndarray]) -> None:
            x = standard(np.concatenate(bags), self.mean, self.scale)
            doc = np.repeat(own, [len(b) for b in bags])
            h, _, _, s = self.encoded(self.w, x)
            new = top.copy()
            np.maximum.at(new, doc, s)
            met = np.unique(doc)
            shrink = np.exp(top[met] - new[met])
            e = np.exp(s - new[doc])
            total[met] *= shrink
            z[met] *= shrink[:, None]
            top[:] = new
            np.add.at(total, doc, e)
            np.add.at(z, doc, e[:, None] * h)

        own, bags, held = [], [], 0
        for k, bag in parts:
            own.append(k)
            bags.append(bag)
            held += len(bag)
            if held >= 1000:
                add(own, bags)
                own, bags, held = [], [], 0
        if own:
            add(own, bags)
        return self.decided(self.w, z / total[:, None])


def gradient(w: dict, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> dict:
    """Of the documents' mean cross-entropy, by every weight."""
    n = len(y)
    h, t, g, att, z, p = Model.forward(w, x, own, n)
    dp = (p - y) / n
    dz = dp[:, None] * w["c"]
    datt = (dz[own] * h).sum(1)
    ds = att * (datt - np.bincount(own, att * datt, n)[own])
    dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
    dh = (att[:, None] * dz[own] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg,
        "a": ((t * g) * ds[:, None]).sum(0), "c": z.T @ dp, "d": np.array([dp.sum()]),
    }


class Bag:
    """A document's passages, small: looks and trigram counts."""

    def __init__(self, looks: np.ndarray, grams: np.ndarray):
        self.looks, self.grams = looks, grams

    def __len__(self) -> int:
        return len(self.looks)

    def dense(self) -> np.ndarray:
        return dense(self.looks, self.grams)

    def packed(self) -> bytes:
        return self.looks.tobytes() + self.grams.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Bag:
        n = len(data) // (4 * N_LOOKS + N_GRAMS)
        at = n * 4 * N_LOOKS
        return cls(np.frombuffer(data[:at], np.float32).reshape(n, N_LOOKS), np.frombuffer(data[at:], np.uint8).reshape(n, N_GRAMS))


def _rows(bag) -> np.ndarray:
    return bag.dense() if isinstance(bag, Bag) else bag.astype(np.float32)


def fit(bags: list, labels: list[int], hidden: int = 24, attention: int = 12, epochs: int = 12, steps: int = 300, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the documents' cross-entropy in float32, in batches of documents, as often as ``epochs``
    says but at least for ``steps`` batches. bags: a Bag or an array of passages x features for each
    document; their order does not matter. With no labels, or all alike, a constant."""
    y = np.array(labels, np.float32)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, prior)
    order = sorted(range(len(bags)), key=lambda k: (labels[k], hashlib.sha1(_rows(bags[k]).tobytes()).digest()))
    bags, y = [bags[k] for k in order], y[order]
    count, total, squares = 0, 0.0, 0.0
    for b in bags:
        x = _rows(b).astype(np.float64)
        count, total, squares = count + len(x), total + x.sum(0), squares + (x * x).sum(0)
    mean = total / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    floor = np.r_[np.full(min(N_LOOKS, len(mean)), 1e-3), np.full(max(0, len(mean) - N_LOOKS), 2e-2)]
    scale = np.where(spread > 1e-5, spread + floor, np.inf)  # what never varied says nothing
    mean, scale, r = mean.astype(np.float32), scale.astype(np.float32), np.random.default_rng(0)
    shapes = {"W": (len(mean), hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "a": (attention,), "c": (hidden,), "d": (1,)}
    w = {k: (r.normal(0, len(mean) ** -0.5 if k == "W" else 0.0 if k in "bd" else 0.3, shape)).astype(np.float32) for k, shape in shapes.items()}
    m, v = {k: np.zeros_like(q) for k, q in w.items()}, {k: np.zeros_like(q) for k, q in w.items()}
    step, epoch = 0, 0
    while epoch < epochs or step < steps:
        epoch += 1
        deal = r.permutation(len(bags))
        for at in range(0, len(deal), batch):
            step += 1
            chosen = deal[at : at + batch]
            few = [_rows(bags[k]) for k in chosen]
            x = standard(np.concatenate(few), mean, scale)
            grad = gradient(w, x, np.repeat(np.arange(len(few)), [len(f) for f in few]), y[chosen])
            for k in w:
                q = (grad[k] + decay * w[k]).astype(np.float32)
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                w[k] = w[k] - rate * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return Model(mean, scale, w, prior)


def _learnt(text: bytes) -> Bag:
    """The passages of a text that are learnt from."""
    looks, grams = (np.concatenate(x) for x in zip(*map(encoded, blocks(text))))
    if len(looks) > MAX_TRAIN_PASSAGES:
        at = np.linspace(0, len(looks) - 1, MAX_TRAIN_PASSAGES).astype(int)
        looks, grams = looks[at], grams[at]
    return Bag(looks, grams)


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 3000, folds: int = 5, held: int = 0) -> Model:
    """Learn from labelled documents outside the held-out fold.

    At most ``max_train_docs`` labelled ids are used, those with the smallest hash, one row of each
    (the least text), and at most ``MAX_TRAIN_PASSAGES`` passages of it; that bounds what reaches the
    driver. Rows without a label, null ids, null texts and labels other than 0 and 1 teach nothing; an
    id with both labels teaches both.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held))
    usable = usable.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    chosen = [tuple(r) for r in usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train_docs).collect()]
    if not chosen:
        return fit([], [])
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, quality int"))  # max_train_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("quality")
        for b in batches:
            bags = [_learnt(t).packed() for t in text_bytes(b.column(0))]
            yield pa.record_batch([b.column(1), pa.array(bags, pa.binary())], ["quality", "bag"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(few, "doc_id")
    d = d.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).where("text is not null")
    got = d.select("text", "quality").mapInArrow(run, "quality int, bag binary").collect()
    return fit([Bag.unpacked(r[1]) for r in got], [r[0] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``docs`` as it is, and quality_score (0 to 1); a column of that name is replaced.

    Null, empty and blank texts are one passage of zeros and get what the model says of that.
    Repeated rows are kept and get equal scores; an empty table gives an empty result. Of a text of
    any length every passage counts, and all have the same size.
    """
    docs = docs.drop("quality_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias("quality_score")).schema
    at, names = docs.columns.index("text"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps_nothing("quality")
        for b in batches:
            parts = ((n, encode(x)) for n, t in enumerate(text_bytes(b.column(at))) for x in blocks(t))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score_blocks(b.num_rows, parts))], names=names)

    return docs.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs, model)
    predicted = F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), predicted)
