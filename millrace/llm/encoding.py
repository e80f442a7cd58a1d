"""Whole-text encoding with the tokenizers library, one library call for each new word.

Pre-tokenisation never lets a token span a space that follows a non-blank character, so a text's
ids are those of its parts between such spaces. Before that the library cuts out the strings of
added tokens (``<|endoftext|>``), which is done here alike. A part of ASCII and Latin-1 letters, which the
normaliser leaves composed, is cut into the vocabulary's words, and the library's model encodes
each word that is new; a part with any other character goes to the library whole. A new part of
letters only is one word; letters before marks, and what a line break parts, are looked up as parts
themselves. Parts and other words are kept per worker in tables of bounded size, as little-endian
unsigned 32-bit ids; a text is then a join of kept bytes.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

from .common import for_worker

_AFTER_BLANK = re.compile(r"\s ")
_GLUED = re.compile(r"(?<=\S) ")
# The word patterns of the two vocabularies, for text of ASCII and Latin-1 letters.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORDS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\sA-Za-z0-9{_LATIN}]+|\s+(?!\S)|\s+", re.ASCII),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+", re.ASCII),
}
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]")
# Byte-level vocabularies write a byte as a character: itself where it is visible, else one above 255.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_WRITTEN = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))
_SPACE = _WRITTEN[0x20]
_LETTERS = {n: chr(n).encode().decode("latin-1").translate(_WRITTEN) for n in range(0xC0, 0x100) if chr(n).isalpha()}
KEPT, KEPT_WORDS = 1_000_000, 200_000
KEPT_BYTES, KEPT_WORDS_BYTES = 96 << 20, 24 << 20  # of strings and ids; objects and slots of full tables are about 85 and 18 MB more
LONGEST_KEPT = 64


def _after_blank(text: str) -> bool:
    """Whether a space follows white space; of printable characters only the space is some."""
    if "  " in text or "\n " in text:
        return True
    return not text.replace("\n", "").isprintable() and bool(_AFTER_BLANK.search(text))


def portions(texts: Iterable[str | None], size: int = 2_000_000) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about ``size`` characters, so memory is bounded."""
    part, held = [], 0
    for t in texts:
        part.append(t or "")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


class _Table(dict):
    """Ids by string, made by ``make`` when first asked for; at most ``kept``, and ``room`` bytes of strings
    and ids. A full table forgets its newest half: what is frequent is met early, so that stays."""

    def __init__(self, make, kept: int, room: int):
        self.make, self.kept, self.room, self.held = make, kept, room, 0

    def __missing__(self, key: str | tuple[str]) -> bytes:
        ids = self.make(key)
        if len(ids) <= 4 * LONGEST_KEPT and len(key) <= LONGEST_KEPT:  # a tuple's string is bounded by its ids
            size = len(ids) + (key if key.__class__ is str else key[0]).__sizeof__()
            if len(self) >= self.kept or self.held + size > self.room:
                self.forget()
            self[key] = ids
            self.held += size
        return ids

    def forget(self) -> None:
        """Built anew, as slots of items that are popped aren't used again and the table would double."""
        first = dict(islice(self.items(), len(self) // 2))
        self.clear()
        self.update(first)
        self.held = sum(map(len, first.values())) + sum((k if k.__class__ is str else k[0]).__sizeof__() for k in first)


class Encoder:
    """kind "byte": byte-level BPE, a part keeps the space before it; "word": white space is dropped.
    share: of the tables' bounds, as smaller tables cost time and no more."""

    def __init__(self, path: str, kind: str, share: float = 1.0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: only added tokens that are taken literally are supported")
        self.added = {t.content: array("I", [n]).tobytes() for n, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.added else None
        self.before = _SPACE if kind == "byte" else ""
        self.parts = _Table(self.part, int(KEPT * share), int(KEPT_BYTES * share))
        self.words = _Table(self.word, int(KEPT_WORDS * share), int(KEPT_WORDS_BYTES * share))
        self.look, self.find, self.tokenize = self.words.__getitem__, _WORDS[kind].findall, self.tokenizer.model.tokenize

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these bytes only the space is hidden
            written = word.replace(" ", _SPACE)
        else:
            written = word.encode().decode("latin-1").translate(_WRITTEN)
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def part(self, key: str | tuple[str]) -> bytes:
        if key.__class__ is str and (key.isascii() or not _OTHER.search(key)):
            if key.isalpha():  # one word
                key = key if self.kind == "byte" else key.lower()
                written = key if key.isascii() else key.translate(_LETTERS)
                return array("I", [t.id for t in self.tokenize(self.before + written)]).tobytes()
            if (word := key.rstrip(string.punctuation)).isalpha():  # a word and marks
                return self.parts[word] + self.words[key[len(word) :]]
            if self.kind == "byte" and key.count("\n") == 1:  # the end of a line and the beginning of another, no other white space
                line, after = key.split("\n")
                if line and after and not line[-1].isspace() and not after[0].isspace():
                    return self.parts[line] + self.words["\n"] + self.parts[after,]
        if self.kind == "byte":
            key = key[0] if isinstance(key, tuple) else " " + key
        if not key.isascii() and _OTHER.search(key):
            return array("I", self.tokenizer.encode(key, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.look, self.find(key.lower() if self.kind == "word" else key)))

    def cut(self, text: str) -> list[str | tuple[str]]:
        """Keys of a text's parts; the first part has no space before it, which a tuple says."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        cut = _GLUED.split(text) if _after_blank(text) else text.split(" ")
        cut[0] = (cut[0],)
        return cut

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        keys = self.cut(text)
        return b"".join(itemgetter(*keys)(self.parts)) if len(keys) > 1 else self.parts[keys[0]]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each whole text (null: empty)."""
        for t in texts:
            if t and any(x in t for x in self.added):
                pieces = self.split_added(t)
                yield b"".join(self.added[x] if n & 1 else self.plain(x) for n, x in enumerate(pieces))
            else:
                yield self.plain(t or "")


def encoder(path: str, kind: str, share: float = 1.0) -> Encoder:
    """One for each worker process."""
    return for_worker(("encoder", path, kind, share), lambda: Encoder(path, kind, share))
