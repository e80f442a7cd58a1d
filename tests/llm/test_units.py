"""The operators' pieces against brute force, without Spark."""

import hashlib
import math
import os
import random
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import encoding, langid, media, packing, pieces, quality, similar, simhash, suffixes
from millrace.llm import neardup_vectors as vectors

ALPHABET = [" ", "  ", "a", "the", "é", "\n", "\t", "🙂", ".", "'s", "12", "ﬁ", "▁", "日本", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "é", "A"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)


def brute_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(texts)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
@settings(deadline=None)
def test_golay_keys_meet_within_two_bits(fp, bits):
    other = fp
    for b in set(bits):
        other ^= 1 << b
    found, look = simhash.golay_keys(np.array([fp, other], np.uint64))
    assert any(found[0, t] in look[1, t] for t in range(3)) and any(found[1, t] in look[0, t] for t in range(3))
    assert ((look >= 0).sum(2) <= 6).all()


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoder_equals_library(kind, name):
    own, lib = encoding.Encoder(P.path(name), kind), Tokenizer.from_file(P.path(name))

    @given(st.lists(texts, max_size=4))
    @settings(max_examples=200, deadline=None)
    def check(many):
        for text, got in zip(many, own.encode(many)):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids

    check()


def test_pieces_equal_library_and_spans_cover():
    path = P.path("piece_bpe_32k.model")
    own, lib = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)

    @given(texts)
    @settings(max_examples=300, deadline=None)
    def check(text):
        ids = own.encode([text])[0]
        assert ids.tolist() == lib.encode(text)
        spans, data = own.spans(text, ids), text.encode()
        if len(ids):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(data) and (spans[1:, 0] == spans[:-1, 1]).all()

    check()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("more", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": False}])
def test_normalizer_equals_library(rule, more):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, **more)
    own = pieces.Normalizer(next(bytes(v) for n, _, v, _, _ in pieces._fields(lib.serialized_model_proto()) if n == 3))
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["ＡＢ", "ﬁ", " ", "　", "é", "é", "ｶﾞ", "\t", "㌔", "x", "ß", "한"]) for _ in range(r.randint(0, 9)))
        normal, origin = own(text)
        assert normal.decode() == lib.normalize(text) and len(origin) == len(normal) + 1 and (np.diff(origin) >= 0).all()


def brute_plan(positions, penalties, limit):
    cost = [0.0]
    for j in range(1, len(positions)):
        cost.append(min(cost[i] + packing.padded(positions[j] - positions[i], limit) - (positions[j] - positions[i]) for i in range(j) if positions[j] - positions[i] <= limit) + penalties[j])
    return cost[-1]


@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 2.0, 24.0])), min_size=1, max_size=40))
@settings(deadline=None)
def test_plan_is_optimal(steps):
    positions, penalties = [0], [0.0]
    for step, penalty in steps:
        positions.append(positions[-1] + step)
        penalties.append(penalty)
    cuts = packing.plan(positions, penalties, 32)
    assert cuts[0] == 0 and cuts[-1] == positions[-1]
    got = sum(packing.padded(b - a, 32) - (b - a) + penalties[positions.index(b)] for a, b in zip(cuts[:-1], cuts[1:]))
    assert got == pytest.approx(brute_plan(positions, penalties, 32))


def test_png_round_trip_and_damage():
    for payload in (b"", b"x", b" " * 192, os.urandom(1000)):
        samples, n = media.from_png(media.to_png(payload))
        assert n == len(payload) and samples.tobytes() == media.pad(payload) and samples.size % 192 == 0 and samples.size
    broken = bytearray(media.to_png(b"abc"))
    broken[60] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(broken))


def test_members_are_retried_by_offset(tmp_path):
    archive = media._Archive(str(tmp_path))
    for k in range(50):
        archive.add(k, bytes([k]) * (k + 1))
    info = archive.close()
    reader = media._Reader({"path": str(tmp_path), "splitbytes": 300})
    parts = [media._Range(info["name"], s, min(s + 300, info["directory"]), info["members"], info["directory"]) for s in range(0, info["directory"], 300)]
    got = [x for p in parts for b in reader.read(p) for x in zip(b["doc_id"].to_pylist(), b["media"].to_pylist())]
    assert got == [(k, bytes([k]) * (k + 1)) for k in range(50)]
    assert __import__("zipfile").ZipFile(tmp_path / info["name"]).testzip() is None
    fs = pafs.LocalFileSystem()

    class Torn:
        def read_at(self, n, at):
            raise OSError("torn")

    run = [(b"%020d.png" % 7, 54, 1, zlib.crc32(b"\0"))]
    assert reader._fetch(fs, str(tmp_path / info["name"]), Torn(), run)["media"].to_pylist() == [b"\0"]
    with pytest.raises(OSError):
        reader.member(fs, str(tmp_path / info["name"]), 54, 1, 0)


def test_many_archives_make_few_partitions(tmp_path):
    writer = media._Writer({"path": str(tmp_path), "archivebytes": 2000})
    ids = list(range(300))
    rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array([b"%d" % k * 50 for k in ids], pa.binary())], ["doc_id", "media"])
    writer.commit([writer.write(iter([rows])), None])
    for most in (1, 4, 50_000):
        reader = media._Reader({"path": str(tmp_path), "splitbytes": 500, "partitions": most})
        parts = reader.partitions()
        assert len(parts) <= 2 * most
        got = [x for p in parts for b in reader.read(p) for x in b["doc_id"].to_pylist()]
        assert sorted(got) == ids
    assert len(parts) > 100


def test_paths_of_stores(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert media._open(path)[1] == str(tmp_path)


def brute_sum(word, vocab, p, k):
    """Sum over all segmentations, by places."""
    out = [1.0] + [0.0] * len(word)
    for i in range(len(word)):
        single = False
        for n, v in enumerate(vocab):
            if word.startswith(v, i):
                single = single or len(v) == 1
                out[i + len(v)] += out[i] * p[n, k]
        if not single:
            out[i + 1] += out[i] * p[len(vocab), k]
    return out[len(word)]


def test_lattice_sums_all_segmentations():
    vocab = ["▁", "a", "b", "ab", "▁a", "ba"]
    model = langid.learn({"x": langid.Counter("ab ba ab".split()), "y": langid.Counter("bb bb".split())}, vocab)
    lattice, p = langid.Lattice(vocab), model["p"]
    words = ["▁ab", "▁ba", "▁abab", "▁cab", "▁" + "abba" * 10 + "c"]
    want = np.array([[brute_sum(w, vocab, p, k) for k in (0, 1)] for w in words])
    assert lattice.arcs(words[:4]).likelihood(p) == pytest.approx(want[:4])
    assert np.exp([lattice.long_likelihood(w, p) for w in words]) == pytest.approx(want)
    one, two = "▁" + "ab" * 400, "▁" + "ab" * 2000  # no underflow, and the log grows with the length
    assert lattice.long_likelihood(two, p) == pytest.approx(5 * lattice.long_likelihood(one, p), rel=0.02)
    s = langid.Scorer(model)
    assert [x[0] for x in s.predict(["ab ba", "bb bb", None, "", "12 !", "² ½ ① Ⅷ", "ab" * 300, "b" * 300])] == ["x", "y", *["und"] * 4, "x", "y"]


def test_long_words_are_learnt_like_short_ones():
    vocab, r = ["▁", "a", "b", "ab", "▁a", "ba"], random.Random(1)
    lattice = langid.Lattice(vocab)
    p = np.random.default_rng(2).random((lattice.size, 2))
    p /= p.sum(0)
    for word in ("▁ab", "▁abba", "▁cab", "▁" + "".join(r.choice("abc") for _ in range(30))):
        counts, out = np.array([[2.0, 3.0]]), np.zeros_like(p)
        lattice.long_expected(word, p, counts[0], out)
        assert out == pytest.approx(lattice.arcs([word]).expected(p, counts))
        change = 1e-6  # expected uses are the derivative of the log-likelihood by the log of a probability
        for n in range(len(p)):
            up, down = p.copy(), p.copy()
            up[n, 0] *= 1 + change
            down[n, 0] *= 1 - change
            slope = 2 * np.log(brute_sum(word, vocab, up, 0) / brute_sum(word, vocab, down, 0)) / (2 * change)
            assert out[n, 0] == pytest.approx(slope, abs=1e-5)


def test_gated_attention_learns_from_bags():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(r.integers(1, 6), 4)) for _ in range(300)]
    labels = [int(b[:, 0].max() < 1) for b in bags]  # one bad passage spoils a document
    model = quality.fit(bags, labels)
    assert ((model.score(bags) >= 0.5) == np.array(labels)).mean() > 0.9
    assert (quality.fit([], []).score(bags[:2]) == 0.5).all()
    assert len(quality.encode(b"")) == len(quality.encode(b" \n ")) == 1


def brute_attention(w, bag):
    """One document's probability, passage by passage."""
    hidden, scores = [], []
    for x in bag:
        h = [math.tanh(sum(x[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(len(w["b"]))]
        t = [math.tanh(sum(h[i] * w["V"][i, j] for i in range(len(h)))) for j in range(len(w["a"]))]
        g = [1 / (1 + math.exp(-sum(h[i] * w["U"][i, j] for i in range(len(h))))) for j in range(len(w["a"]))]
        hidden.append(h)
        scores.append(sum(t[j] * g[j] * w["a"][j] for j in range(len(t))))
    e = [math.exp(s) for s in scores]
    z = [sum(e[n] * hidden[n][j] for n in range(len(bag))) / sum(e) for j in range(len(w["b"]))]
    return 1 / (1 + math.exp(-(sum(z[j] * w["c"][j] for j in range(len(z))) + w["d"][0])))


def test_attention_and_its_gradient_against_plain_loops():
    r = np.random.default_rng(3)
    shapes = {"W": (4, 5), "b": 5, "V": (5, 3), "U": (5, 3), "a": 3, "c": 5, "d": 1}
    w = {k: r.normal(size=s) for k, s in shapes.items()}
    bags = [r.normal(size=(n, 4)) for n in (1, 3, 7)]
    own, y = np.repeat(np.arange(3), [1, 3, 7]), np.array([1.0, 0.0, 1.0])
    want = [brute_attention(w, b) for b in bags]
    model = quality.Model(np.zeros(4), np.ones(4), w, 0.5)
    assert model.score(bags) == pytest.approx(want)
    parts = [(n, b[i : i + 2]) for n, b in enumerate(bags) for i in range(0, len(b), 2)]
    assert model.score_blocks(3, iter(parts)) == pytest.approx(want)
    got = quality.gradient(w, np.concatenate(bags), own, y)

    def loss():
        p = [brute_attention(w, b) for b in bags]
        return -np.mean([math.log(q if t else 1 - q) for q, t in zip(p, y)])

    for k, values in w.items():
        for at in np.ndindex(values.shape):
            kept = values[at]
            values[at] = kept + 1e-6
            up = loss()
            values[at] = kept - 1e-6
            slope = (up - loss()) / 2e-6
            values[at] = kept
            assert got[k][at] == pytest.approx(slope, abs=1e-7)


def test_letters_that_spell_nothing_are_told_from_words():
    """Labels of its own: the same words, and with their letters mixed; looks are the same, trigrams are not."""
    r = random.Random(4)
    part = [a + b for a in "bdklmnrst" for b in "aeiou"]
    words = ["".join(r.choice(part) for _ in range(r.randint(1, 4))) + r.choice(["", "n", "s"]) for _ in range(400)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(20, 200)))
    mixed = lambda t: " ".join("".join(r.sample(w, len(w))) for w in t.split(" "))
    good = [text() for _ in range(150)]
    model = quality.fit([quality._learnt(t.encode()) for g in good for t in (g, mixed(g))], [1, 0] * len(good))
    held = [text() for _ in range(40)]
    score = lambda t: model.score([quality.encode(t.encode())])[0]
    assert sum(score(t) >= 0.5 for t in held) >= 38 and sum(score(mixed(t)) < 0.5 for t in held) >= 38


def test_training_is_bounded_and_bags_are_small():
    r = np.random.default_rng(2)
    bag = quality._learnt(b"some words of text, " * 3000)
    again = quality.Bag.unpacked(bag.packed())
    assert (again.dense() == bag.dense()).all() and len(bag.packed()) == quality.MAX_TRAIN_PASSAGES * (4 * quality.N_LOOKS + quality.N_GRAMS)
    bags = [quality.Bag(r.random((4, quality.N_LOOKS)).astype(np.float32), r.integers(0, 3, (4, quality.N_GRAMS)).astype(np.uint8)) for _ in range(50)]
    labels = [k % 2 for k in range(50)]
    model, turned = quality.fit(bags, labels), quality.fit(bags[::-1], labels[::-1])
    assert all((model.w[k] == turned.w[k]).all() for k in model.w) and model.w["W"].dtype == np.float32  # order does not matter


def test_long_texts_have_passages_of_one_size():
    text = b"word of text, " * 200_000
    bags = [quality.encode(b) for b in quality.blocks(text)]
    assert len(bags) == 3 and abs(sum(map(len, bags)) - len(text) / quality.PASSAGE_BYTES) < 10
    assert np.concatenate(bags).std(0).max() < 0.2  # no feature depends on the length
    assert len(quality._learnt(text)) == quality.MAX_TRAIN_PASSAGES
    assert [b"".join(quality.blocks(x)) == x for x in (b"", b"a", text)] == [True] * 3


@pytest.mark.parametrize("dim,count", [(16, 100), (64, 50_000), (64, 10**9), (768, 10**6)])
def test_hadamard_and_recall(dim, count):
    size = vectors._padded(dim)
    x, h = np.random.default_rng(0).normal(size=(3, size)), np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    assert vectors.hadamard(x) == pytest.approx(x @ h)
    r = np.random.default_rng(1)
    a = vectors.unit(r.normal(size=(2000, dim)))
    b = r.normal(size=(2000, dim))
    b = vectors.unit(b - (a * b).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    hashes = vectors.hashes_for(count, dim)
    tables = vectors.tables_for(dim, hashes)
    ka, kb = vectors.keys(a, tables, hashes).reshape(2000, -1), vectors.keys(b, tables, hashes).reshape(2000, -1)
    found = np.zeros(2000, bool)
    for k in range(kb.shape[1]):
        found |= (ka == kb[:, k : k + 1]).any(1)
    assert found.mean() >= 0.99


def test_vectors_of_a_bucket_against_plain_loops():
    r = np.random.default_rng(5)
    for whole in (True, False):
        x = vectors.unit(r.normal(size=(5, 8))[r.integers(0, 5, 30)] + 0.1 * r.normal(size=(30, 8)))
        ks, copies = r.integers(0, 9, (30, 4)), r.integers(1, 5, 30)
        ks[:, 0] = 5  # all are in the bucket
        side = np.full(30, 2) if whole else np.arange(30) // 14 % 2
        n, reach = vectors.verify(5, x, ks, copies, side, 0.95)
        want, group = np.zeros(30, int), list(range(30))
        pairs = [(i, j) for i in range(30) for j in range(30) if i != j and (whole or side[i] != side[j]) and x[i] @ x[j] >= 0.95]
        for i, j in pairs:
            if min(set(ks[i]) & set(ks[j])) == 5:
                want[i] += copies[j]
        for _ in range(30):
            for i, j in pairs:
                group[i] = min(group[i], group[j])
        assert n.tolist() == want.tolist() and reach.tolist() == group and len(pairs) > 30


def test_suffix_sort_equals_plain_sort():
    r = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        data = r.integers(0, alphabet, 3000).astype(np.uint8)
        data[1500:1900] = data[:400]
        at = r.choice(2900, 400)
        group = np.sort(r.integers(0, 20, 400))
        order = suffixes.Suffixes(data).sort(at, group)
        want = sorted(range(400), key=lambda i: (group[i], data[at[i] : at[i] + 100].tobytes(), i))
        assert order.tolist() == want
        seen, expect = set(), []
        for i in range(400):
            k = (group[i], data[at[i] : at[i] + 100].tobytes())
            expect.append(k in seen)
            seen.add(k)
        assert suffixes.Suffixes(data).repeats(at, group).tolist() == expect


def test_hash_collisions_are_found(monkeypatch):
    data = np.random.default_rng(3).integers(0, 9, 1000).astype(np.uint8)
    at, group = np.array([0, 200, 400]), np.zeros(3, np.int64)
    monkeypatch.setattr(suffixes.Suffixes, "hashes", lambda self, at, n: np.zeros(len(at), np.uint64))
    assert not suffixes.Suffixes(data).repeats(at, group).any()


def local_repeats(rows, cap=10**9):
    """The operator's steps in this process, a shuffle being a sort: bytes to remove of each document."""
    docs = [pa.record_batch([pa.array([i], pa.int64()), pa.array([t.decode("latin-1")])], ["rid", "text"]) for i, t in rows]
    table = pa.Table.from_batches([x for b in docs for x in suffixes._seen([b])]).sort_by("key")
    got = pa.Table.from_batches(list(suffixes._first(table.to_batches(max_chunksize=7)))).to_pylist()
    gone = {i: np.zeros(len(t), bool) for i, t in rows}
    asked: dict = {}
    for r in got:
        if r["key"] is None:
            gone[r["rid"]][r["x"] : r["y"]] = True
        else:
            asked.setdefault(r["rid"], []).append(r)
    many = {k for k, n in Counter(r["key"] for x in asked.values() for r in x).items() if n > cap}
    kind, text = pa.list_(pa.struct([("key", pa.int64()), ("x", pa.int64())])), dict(rows)

    def batch(hot):
        wanted = {i: [{"key": r["key"], "x": r["x"]} for r in x if (r["key"] in many) == hot] for i, x in asked.items()}
        wanted = {i: x for i, x in wanted.items() if x}
        texts = pa.array([text[i].decode("latin-1") for i in wanted], pa.string())
        return pa.record_batch([texts, pa.array(list(wanted), pa.int64()), pa.array(list(wanted.values()), kind)], ["text", "rid", "asked"])

    ctx = pa.Table.from_batches(list(suffixes._contexts([batch(False)]))).sort_by([(c, "ascending") for c in ("key", "rid", "at")])
    for b in suffixes._sorted_out(ctx.to_batches(max_chunksize=50)):
        for r in b.to_pylist():
            gone[r["rid"]][r["x"] : r["y"]] = True
    places = sorted((r["bytes"], r["rid"], r["x"]) for b in suffixes._windows([batch(True)]) for r in b.to_pylist())
    for (before, _, _), (value, i, x) in zip(places, places[1:]):
        if before == value:
            gone[i][x : x + 100] = True
    return gone


def some_texts():
    r = np.random.default_rng(6)
    line = lambda n, k: bytes(r.integers(97, 97 + k, n).astype(np.uint8))
    shared, long = line(150, 20), line(900, 20)
    texts = [line(400, 20), shared + line(200, 20), line(90, 20) + shared + line(60, 20), long, long, line(60, 20) + long[100:700], b"ab" * 300, b"", line(99, 4)]
    texts += [line(3, 20) + shared[:110] + line(3, 20) for _ in range(20)] + [line(500, 1), b"x" * 250]
    return list(enumerate(texts))


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        out[i] = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                out[i][p : p + 100] = True
            seen.add(t[p : p + 100])
    return out


@pytest.mark.parametrize("collide", ["", "contexts", "anchors", "suffixes", "all"])
@pytest.mark.parametrize("cap", [10**9, 1])
def test_collisions_remove_nothing(monkeypatch, collide, cap):
    """Hashes that are all equal: only bytes can tell contexts and suffixes apart."""
    plain = suffixes.anchors

    def anchors(text):
        h, c, *rest = plain(text)
        return (h * np.uint64(collide not in ("anchors", "all")), c * np.uint64(collide not in ("contexts", "all")), *rest)

    monkeypatch.setattr(suffixes, "anchors", anchors)
    if collide in ("suffixes", "all"):
        monkeypatch.setattr(suffixes.Suffixes, "hashes", lambda self, at, n: np.zeros(len(at), np.uint64))
    rows = some_texts()
    got, want = local_repeats(rows, cap), plain_repeats(rows)
    assert all((got[i] == want[i]).all() for i in want) and any(x.any() for x in want.values())


def test_long_texts_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 130)
    monkeypatch.setattr(suffixes, "FOLDED", 500)
    rows = some_texts()
    got, want = local_repeats(rows), plain_repeats(rows)
    assert all((got[i] == want[i]).all() for i in want)
    for n in (0, 99, 100, 129, 229, 230, 1000):
        starts = [s + k for s, piece in suffixes.pieces(b"x" * n) for k in range(len(piece) - 99)]
        assert starts == list(range(max(0, n - 99)))


def test_new_words_go_to_the_model_once():
    """Parts of letters only take no way through the word pattern and are kept once; ids are the library's."""
    r = random.Random(9)
    stems = ["".join(r.choices("abcdefgéßøXYZ", k=r.randint(1, 12))) for _ in range(300)]
    odd = [".", ",''", "'s", "'S", "--x", "3", "3.", "\n", ".\n", "\n\n", "\n.", "\t", "\t\nq", "\nÉa", "ª", "µm", "ł", ".\nx\ny", "_", "\xa0", "\x85z", "\n'll", "%%%\nDans&&&"]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        own = encoding.Encoder(P.path(name), kind)
        calls, plain = [], own.tokenize
        own.tokenize = lambda x: calls.append(x) or plain(x)
        text = " ".join(stems * 2)
        texts = [text] + [" ".join(x + r.choice(odd) for x in r.choices(stems, k=40)) for _ in range(200)] + [x + y for x in stems[:20] for y in odd]
        want = [array("I", own.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        got = list(own.encode(texts[:1]))
        assert got == want[:1] and len(calls) <= len(set(stems)) + 1 and len(own.words) <= 1  # a text's first part has no space
        assert list(own.encode(texts[1:])) == want[1:]


def test_tables_of_parts_are_bounded_in_bytes():
    """Long parts in a script of several bytes a character, which a bound on their number alone lets grow
    to several times its usual size; also when a table forgets, and with ids as the library's."""
    r = random.Random(4)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = encoding.Encoder(P.path("byte_bpe_50k.json"), "byte")
    own.parts.kept, own.parts.room, most = 3000, 200_000, 0
    for _ in range(300):
        text = " ".join("".join(r.choices("ждщ日本", k=r.randint(1, 12))) for _ in range(40)) + r.choice(["", "\nжж x", "  日"])
        assert np.frombuffer(b"".join(own.encode([text])), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        most = max(most, sum(len(v) + sys.getsizeof(k[0] if isinstance(k, tuple) else k) for k, v in own.parts.items()))
    assert 50_000 < most <= 200_000


def test_a_full_table_does_not_double_its_slots():
    table, most = encoding._Table(lambda key: b"", 10_000, 1 << 30), 0
    for n in range(50_000):
        assert table[str(n)] == b"" and len(table) <= 10_000
        most = max(most, sys.getsizeof(table))
    assert "0" in table and most <= 1.5 * sys.getsizeof(dict.fromkeys(map(str, range(10_000))))


def test_encoder_fills_its_share_of_the_tables():
    few, all_ = (encoding.Encoder(P.path("byte_bpe_50k.json"), "byte", share) for share in (0.001, 1.0))
    texts = [" ".join(f"w{n * 7 + k}x, {k}" for k in range(50)) + "\n end" for n in range(400)]
    assert list(few.encode(texts)) == list(all_.encode(texts))
    assert len(few.parts) <= encoding.KEPT / 1000 < len(all_.parts) and len(few.words) <= encoding.KEPT_WORDS / 1000 < len(all_.words)
    assert few.parts.held <= encoding.KEPT_BYTES / 1000 and few.words.held <= encoding.KEPT_WORDS_BYTES / 1000


def test_sketches_estimate_similarity():
    r = np.random.default_rng(7)
    for size in (5, 50, 500, 20_000):
        for share in (0.5, 0.7, 0.8, 0.95):
            common = r.integers(0, 2**64, size, np.uint64)
            own = lambda: r.integers(0, 2**64, round(size * (1 - share) / 2 / share), np.uint64)
            a, b = np.concatenate([common, own()]), np.concatenate([common, own()])
            true = size / (len(a) + len(b) - size)
            got = similar.alike(similar.sketch(a)[None], similar.sketch(b)[None])[0]
            assert got > true - similar.MARGIN and (size < 50 or got < true + similar.MARGIN)


def test_digest_helper():
    assert suffixes.kept_bytes(b"abcdef", [1, 2], [3, 4]) == (b"aef", 3, 1)
    assert hashlib.sha256(suffixes.kept_bytes(b"", [], [])[0]).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert pa.array([1]).to_pylist() == [1]
