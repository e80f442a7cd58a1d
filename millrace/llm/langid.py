"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a
word is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities,
found by a forward pass over its characters; a text's likelihood is the product over its words.
Pieces never cross a word start, so this equals the sum over all segmentations of the text. The
probabilities are learnt by expectation maximisation (forward-backward counts). Scores of words are
kept per worker, bounded in number, so that most of a text costs one lookup a word. Words of up to
``SHORT`` characters are passed over many at a time; a longer one, such as a text without blanks,
on its own, with its sums scaled and no more of them held than the longest piece reaches back.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import for_worker, remainder, table

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_EDGES = regex.compile(r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$")
SHORT = 40  # at most 62: places are packed in 6 bits
_KEPT_CHUNKS = 200_000
#: Characters of a document beyond which it is not learnt from.
MAX_TRAIN_CHARS = 50_000


def vocabulary(model_path: str) -> list[str]:
    """Pieces with their word-start mark, lower-cased; control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(sp.get_piece_size())
    return sorted({sp.id_to_piece(i).lower() for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


class Lattice:
    """Pieces as a trie; ``arcs`` finds every piece that fits into each of some short words."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last stands for any character without a piece
        self.root: dict = {}
        for n, piece in enumerate(pieces):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = n

    def pieces_at(self, word: str, i: int) -> Iterator[tuple[int, int]]:
        """End and number of each piece that begins at place i; a character without a piece of its own is one."""
        node, j, single = self.root, i, False
        while j < len(word) and word[j] in node:
            node = node[word[j]]
            j += 1
            if "" in node:
                single = single or j == i + 1
                yield j, node[""]
        if not single:
            yield i + 1, self.size - 1

    def long_likelihood(self, word: str, p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of a word of any length, for each language."""
        langs = range(p.shape[1])
        ahead: dict[int, list[float]] = {0: [1.0] * len(langs)}  # sums at places not yet passed
        log = [0.0] * len(langs)
        for i in range(len(word)):
            here = ahead.pop(i)
            scale = [x or 1e-300 for x in here]
            for k in langs:
                log[k] += math.log(scale[k])
            for x in ahead.values():  # all sums are relative to the one here
                for k in langs:
                    x[k] /= scale[k]
            for j, n in self.pieces_at(word, i):
                row, to = p[n], ahead.setdefault(j, [0.0] * len(langs))
                for k in langs:
                    to[k] += row[k]
        return np.array(log) + np.log(np.maximum(ahead[len(word)], 1e-300))

    def long_expected(self, word: str, p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected uses of each piece in one long word: both passes with scaled sums."""
        size = len(word)
        arcs = [list(self.pieces_at(word, i)) for i in range(size)]
        # alpha[i], beta[i]: sums of the ways to reach i and to go on from it, each over a power of e.
        alpha, beta = np.full((size + 1, p.shape[1]), -np.inf), np.full((size + 1, p.shape[1]), -np.inf)
        alpha[0] = beta[size] = 0
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        for i in range(size):
            for j, n in arcs[i]:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + logs[n])
        for i in range(size - 1, -1, -1):
            for j, n in arcs[i]:
                beta[i] = np.logaddexp(beta[i], beta[j] + logs[n])
                out[n] += counts * np.exp(np.minimum(alpha[i] + logs[n] + beta[j] - alpha[size], 0))

    def arcs(self, words: list[str]) -> Arcs:
        out, ends, root, other = [], [0], self.root, self.size - 1
        for word in words:  # pieces_at, written out: most of the time goes here
            size = len(word)
            for i in range(size):
                node, at, j, single = root, i << 26, i, False
                while j < size and word[j] in node:
                    node = node[word[j]]
                    j += 1
                    if "" in node:
                        out.append(at | j << 20 | node[""])
                        single = single or j == i + 1
                if not single:
                    out.append(at | (i + 1) << 20 | other)
            ends.append(len(out))
        return Arcs(np.array(out, np.int64), np.diff(ends), np.fromiter(map(len, words), np.int64, len(words)))


class Arcs:
    """Segmentation lattices of many words at once: arcs (from, to, piece) packed in 6, 6 and 20 bits."""

    def __init__(self, arcs: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        order = np.argsort(arcs >> 20, kind="stable")
        key = (arcs >> 20)[order]
        self.w = np.repeat(np.arange(len(sizes)), counts)[order]
        self.i, self.j, self.n = key >> 6, key & 63, (arcs & 0xFFFFF)[order]
        # In a step all arcs have the same ends, so no word is met twice.
        self.steps = np.concatenate([np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), [len(key)]]).tolist() if len(key) else [0]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: pieces x languages. Sums over the segmentations of each prefix."""
        alpha = np.zeros((SHORT + 2, len(self.sizes), p.shape[1]))
        alpha[0] = 1
        for s, e in zip(self.steps[:-1], self.steps[1:]):
            w = self.w[s:e]
            alpha[self.j[s], w] += alpha[self.i[s], w] * p[self.n[s:e]]
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.sizes, np.arange(len(self.sizes))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, pieces x languages; counts: words x languages."""
        alpha = self.forward(p)
        every = np.arange(len(self.sizes))
        beta = np.zeros_like(alpha)
        beta[self.sizes, every] = counts / np.maximum(alpha[self.sizes, every], 1e-300)
        out = np.zeros_like(p)
        for s, e in zip(self.steps[-2::-1], self.steps[:0:-1]):
            w, n = self.w[s:e], self.n[s:e]
            x = beta[self.j[s], w] * p[n]
            np.add.at(out, n, alpha[self.i[s], w] * x)
            beta[self.i[s], w] += x
        return out


def spelled(chunk: str) -> str:
    """A chunk between white space as a marked word, without outer non-letters; empty if it has no letter."""
    if not _LETTER.search(chunk):
        return ""
    return "▁" + _EDGES.sub("", chunk).lower()


def learn(counts: dict[str, Counter], pieces: list[str], rounds: int = 3, smoothing: float = 0.1) -> dict:
    """counts: for each language its chunks and how often they occur."""
    lattice, langs, words = Lattice(pieces), sorted(counts), {}
    p = np.full((lattice.size, len(langs)), 1 / lattice.size)
    rows: list[list[float]] = []
    for k, lang in enumerate(langs):
        for chunk, n in counts[lang].items():
            if w := spelled(chunk):
                at = words.setdefault(w, len(rows))
                if at == len(rows):
                    rows.append([0.0] * len(langs))
                rows[at][k] += n
    short, long = [w for w in words if len(w) <= SHORT], [w for w in words if len(w) > SHORT]
    seen = np.array([rows[words[w]] for w in short]).reshape(len(short), len(langs))
    blocks = [(lattice.arcs(short[i : i + 20_000]), seen[i : i + 20_000]) for i in range(0, len(short), 20_000)]
    for _ in range(rounds if langs else 0):
        uses = smoothing + sum((a.expected(p, n) for a, n in blocks), np.zeros_like(p))
        for w in long:
            lattice.long_expected(w, p, np.array(rows[words[w]]), uses)
        p = uses / uses.sum(0)
    return {"pieces": pieces, "langs": langs, "p": p}


class Scorer:
    """Log-likelihoods of texts under each language of a model."""

    def __init__(self, model: dict):
        self.langs, self.p, self.lattice = model["langs"], model["p"], Lattice(model["pieces"])
        self.clear()

    def clear(self) -> None:
        """Row 0 is for chunks without letters."""
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, len(self.langs)))
        self.held = 0  # characters of long words

    def meet(self, chunks: set[str]) -> None:
        words = {c: spelled(c) for c in chunks}
        new = list({w for w in words.values() if w not in self.words})
        short, long = [w for w in new if len(w) <= SHORT], [w for w in new if len(w) > SHORT]
        at = len(self.scores)
        self.words.update((w, at + n) for n, w in enumerate(short + long))
        blocks = [np.log(np.maximum(self.lattice.arcs(short[i : i + 10_000]).likelihood(self.p), 1e-300)) for i in range(0, len(short), 10_000)]
        alone = [self.lattice.long_likelihood(w, self.p)[None] for w in long]
        self.scores = np.concatenate([self.scores, *blocks, *alone])
        self.chunks.update((c, self.words[w]) for c, w in words.items())
        self.held += sum(map(len, long))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """In portions of some megabytes, so that memory doesn't follow the batch."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < 4_000_000:
                size += len(texts[end] or "")
                end += 1
            out += self._portion(texts[at:end])
            at = end
        return out

    def _portion(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.chunks) > _KEPT_CHUNKS or self.held > 4_000_000:
            self.clear()
        cut = [t.split() if t and self.langs and _LETTER.search(t) else None for t in texts]
        if new := {c for x in cut if x for c in x if c not in self.chunks}:
            self.meet(new)
        out, look = [], self.chunks.__getitem__
        for x in cut:
            if not x:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[np.fromiter(map(look, x), np.int64, len(x))].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(docs: DataFrame, tokenizer_path: str, max_train_docs: int = 1500, max_train_chars: int = MAX_TRAIN_CHARS, folds: int = 4, held: int = 2) -> dict:
    """Learn from documents (doc_id, text, lang) outside the held-out fold.

    At most ``max_train_docs`` ids are used, as many of each language if it has them, those with the
    smallest hash among documents of at most ``max_train_chars`` characters, and one row of each, the
    least by text and language. That bounds what the driver gathers whatever the size of the corpus,
    and a language is learnt however few of the documents are in it; scoring covers every row. Null
    ids, texts and languages teach nothing.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= max_train_chars) & (remainder("doc_id", folds) != held))
    langs = d.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(max_train_docs)
    share = -(-max_train_docs // max(langs.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = d.join(F.broadcast(langs), "lang").where(place * F.col("ids") < 4 * share).select("lang", "doc_id", place.alias("place")).distinct()
    of_lang = Window.partitionBy("lang").orderBy("place", "doc_id")  # about four times as many as are taken
    few = few.withColumn("n", F.row_number().over(of_lang)).where(F.col("n") <= share)
    ids = sorted({r[0] for r in few.orderBy("n", "place", "doc_id").limit(max_train_docs).select("doc_id").collect()})
    counts: dict[str, Counter] = {}
    if ids:
        one = d.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d"))
        for text, lang in one.select("d.text", "d.lang").toLocalIterator():
            counts.setdefault(lang, Counter()).update(text.split())
    return learn(counts, vocabulary(tokenizer_path))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Every column of ``docs`` as it is, and lang_pred, lang_score (0 to 1: the posterior).

    Columns of these two names are replaced. Null texts and texts without a letter (Unicode category
    L) are ``und`` with score 0, as is everything if nothing could be learnt. Of languages that tie,
    the first in order wins. Repeated rows are kept, an empty table gives an empty result, and a text
    of any length is scored whole.
    """
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = for_worker(("langid", key), lambda: Scorer(sent.value))
        for b in batches:
            got = scorer.predict(b.column(at).to_pylist())
            columns = [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.drop("lang_pred", "lang_score").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    docs = docs.drop("lang_pred", "lang_score")
    at, names = docs.columns.index("text"), schema.names
    return docs.mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("piece_bpe_32k.model")
    model = train(docs, tokenizer_path)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
