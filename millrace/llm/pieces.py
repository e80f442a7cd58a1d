"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it covers.

The model file is read directly: its normaliser's compiled character map (a double-array trie of
source prefixes and a pool of replacements) is applied longest prefix first, and for every byte of
normalised text the source byte it came from is recorded. The normalised text is encoded by the
sentencepiece library with a copy of the model whose own normaliser does nothing, and each piece's
normalised bytes are projected through the record to a span of the original bytes.

Where no piece of the vocabulary has a word-start mark after another character, no piece spans
words, and words are encoded once and kept per worker in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_worker, table
from .encoding import portions

SPACE = "▁"
MARK = SPACE.encode()
KEPT = 300_000
_WORD = re.compile(f"(?<=[^ {SPACE}]) ")


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int, int, int]]:
    """Protocol-buffer fields: number, wire type, value, start, end."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        start, key = at, number()
        kind = key & 7
        if kind == 0:
            value: bytes | int = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, kind, value, start, at


def _field(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class Normalizer:
    """The normaliser of a model: character map, dummy prefix, extra white space, escaping."""

    def __init__(self, spec: bytes):
        self.prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        for number, _, value, _, _ in _fields(spec):
            if number == 2:
                charsmap = bytes(value)
            elif number in (3, 4, 5):
                setattr(self, {3: "prefix", 4: "squeeze", 5: "escape"}[number], bool(value))
        size = int.from_bytes(charsmap[:4], "little")
        self.units = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
        self.pool = charsmap[4 + size :]
        self.kept: dict[bytes, tuple[int, bytes] | None] = {}

    @property
    def plain(self) -> bool:
        return not self.units and not self.squeeze and self.escape and self.prefix

    def prefix_at(self, data: bytes, at: int) -> tuple[int, bytes]:
        """The longest source prefix at ``at`` that the map replaces, and by what; else one character."""
        units, node, found = self.units, 0, None
        if units:
            unit = units[0]
            node = (unit >> 10) << ((unit & 512) >> 6)
            for n in range(at, len(data)):
                c = data[n]
                node ^= c
                if node >= len(units):
                    break
                unit = units[node]
                if unit & 0x800000FF != c:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    value = units[node] & 0x7FFFFFFF
                    found = n + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        if found:
            return found
        size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
        return size, data[at : at + size]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte where its origin starts."""
        data = text.encode()
        if self.plain:  # nothing to look up: marks for spaces
            if not data:
                return b"", np.zeros(1, np.int64)
            source = np.frombuffer(data, np.uint8)
            at = np.repeat(np.arange(len(data)), np.where(source == 32, len(MARK), 1))
            return MARK + data.replace(b" ", MARK), np.concatenate([[0] * len(MARK), at, [len(data)]])
        out, origin, at = bytearray(), [], 0
        space = MARK if self.escape else b" "
        if self.squeeze:
            while at < len(data):
                size, new = self.prefix_at(data, at)
                if new != b" ":
                    break
                at += size
        if at == len(data):
            return b"", np.array([at])
        if self.prefix:
            out += space
            origin += [at] * len(space)
        blank = self.squeeze
        while at < len(data):
            size, new = self.prefix_at(data, at)
            if blank and self.squeeze:
                new = new.lstrip(b" ")
            if new:
                made = new.replace(b" ", space)
                out += made
                origin += [at] * len(made)
                blank = new.endswith(b" ")
            at += size
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while out.endswith(space):
                at = origin[-len(space)]
                del out[-len(space) :], origin[-len(space) :]
        return bytes(out), np.array([*origin, at])


class Pieces:
    """A model: encode with spans, decode."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        spec = next((bytes(v) for n, _, v, _, _ in _fields(proto) if n == 3), b"")
        self.normalizer = Normalizer(spec)
        bare = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
        kept = b"".join(proto[s:e] for n, _, _, s, e in _fields(proto) if n != 3)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=kept + _field(3, bare))
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.sizes = np.array([1 if self.library.is_byte(i) else len(x.encode()) for i, x in enumerate(names)])
        self.unknown = self.library.unk_id()
        self.apart = self.normalizer.plain and not any(SPACE in x.lstrip(SPACE) for x in names) and any(map(self.library.is_byte, range(n)))
        self.words: dict[str, bytes] = {}
        self.decimals = [str(i) for i in range(n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, exactly as the library's."""
        if not self.apart:
            return [np.array(x, np.int32) for x in self.bare.encode([self.normalizer(t)[0].decode() for t in texts], num_threads=1)]
        if len(self.words) > KEPT:
            self.words.clear()
        cut = [[] if not t else t.split(" ") if "  " not in t and SPACE not in t and t[0] != " " else _WORD.split(t) for t in texts]
        kept = self.words
        new = list({w for x in cut for w in x if w not in kept})
        marked = [SPACE + w.replace(" ", SPACE) for w in new]
        self.words.update((w, array("i", x).tobytes()) for w, x in zip(new, self.bare.encode(marked, num_threads=1)))
        look = self.words.__getitem__
        return [np.frombuffer(b"".join(map(look, x)), np.intc) for x in cut]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First and past-the-end original byte of each piece (n, 2); empty for the dummy prefix."""
        normal, origin = self.normalizer(text)
        sizes = self.sizes[ids]
        if len(ids) and sizes.sum() != len(normal) or (ids == self.unknown).any():
            # An unknown piece covers what the library says it covers.
            sizes = np.array([len(p.surface.encode()) for p in self.bare.encode(normal.decode(), out_type="immutable_proto").pieces], np.int64)
        ends = np.cumsum(sizes)
        return np.stack([origin[ends - sizes], origin[ends]], 1)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def pieces(path: str) -> Pieces:
    return for_worker(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends): ids and original byte spans of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            at = 0
            for part in portions(b.column(1).to_pylist()):
                ids = own.encode(part)
                spans = [own.spans(t, x) for t, x in zip(part, ids)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                columns = [np.concatenate(ids).astype(np.int32), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)]
                yield pa.record_batch([b.column(0).slice(at, len(part)), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)], ["doc_id", "ids", "starts", "ends"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_covered, the original
    bytes that the pieces' spans cover. Repeated rows are kept; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            at = 0
            for part in portions(b.column(1).to_pylist()):
                rows = []
                for t, ids in zip(part, own.encode(part)):
                    spans = own.spans(t, ids)
                    listed = ids.tolist()
                    text = own.library.decode(listed)
                    rows.append((len(listed), hashlib.sha256(",".join(map(own.decimals.__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), int((spans[:, 1] - spans[:, 0]).sum())))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([b.column(0).slice(at, len(part)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def op6_sentencepiece(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("piece_bpe_32k.model")
    return digest(table(spark, sf_dir, "documents"), tokenizer_path)
