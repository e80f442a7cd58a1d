"""WARC archives, whitening and the divergence audit against brute force on odd rows."""

import gzip
import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence, warc, whitening

PAGES = "page_id long, url string, html string, key int, payload string, chunk int"


def odd_pages():
    long, other = "<p>ä</p>" * 500, "x" * 1000
    rows = [(1, "http://a/1", long), (7, "http://a/7", long), (3, None, long), (None, "http://a/n", long), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", other)]
    rows += [(8, "http://a b\r\nWARC-Type: evil", ""), (9, "u", None), (10, "u", "日本" * 40_000), (10, "u", "日本" * 40_000), (11, "u", "日本" * 40_000), (11, "u", "日本" * 40_000), (12, "u", "once" * 400)]
    return rows + [(None, "u", "z" * 2000), (None, "v", "z" * 2000), (1, "http://a/1", long)]


def brute_records(rows):
    text = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, h in text:
        ids = [j for j, g in text if g == h and j is not None] if len(h) >= 1000 else []
        again = bool(ids) and i != max(ids)
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return Counter(out)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in odd_pages()], PAGES).repartition(3)


@pytest.mark.parametrize("chunk,segment,archive", [(1 << 16, 1 << 20, 1 << 20), (1000, 1, 1), (7777, 500, 2000)])
def test_warc_round_trip(spark, pages, tmp_path, chunk, segment, archive):
    path = str(tmp_path / "w")
    segments = warc.write(warc.chunked(warc.decided(pages), chunk), path, archive, segment)
    assert segments.agg(F.sum("records")).first()[0] == len(odd_pages())
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"torn")  # of a lost task: no segment names it
    got = warc.read(spark, path, chunk)
    assert Counter(map(tuple, warc.summary(got).collect())) == brute_records(odd_pages())
    assert warc.dangling(got).count() == 0
    parts = {}
    for r in got.collect():
        assert len(r.data) <= chunk
        parts.setdefault((r.page_id, r.uri, r.record_type, r.payload_digest), []).append(r)
    for (_, _, kind, digest), rows in parts.items():
        for at in range(0, len(rows), rows[0].last and 1 or max(r.chunk for r in rows) + 1):
            run = rows[at : at + max(r.chunk for r in rows) + 1]
            data = b"".join(r.data for r in run)
            assert [r.chunk for r in run] == list(range(len(run))) and [r.last for r in run] == [False] * (len(run) - 1) + [True]
            assert data == b"" if kind == "revisit" else hashlib.sha1(data).hexdigest() == digest
            for k, r in enumerate(run):
                assert kind == "revisit" or r.digest == hashlib.sha1(b"".join(x.data for x in run[: k + 1])).hexdigest()
    assert {r.uri for r in got.collect()} >= {"http://a/7", "http://a%20b%0D%0AWARC-Type:%20evil"}


def test_warc_files_are_plain_gzip_members(spark, pages, tmp_path):
    warc.write(warc.chunked(warc.decided(pages)), str(tmp_path / "w"))
    kinds = Counter()
    for p in (tmp_path / "w").glob("*.warc.gz"):
        data = gzip.decompress(p.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[length : length + 4] == b"\r\n\r\n"
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1]] += 1
            data = rest[length + 4 :]
    assert kinds == {b"response": 11, b"revisit": 6}


def test_warc_damage_and_empty_tables(spark, pages, tmp_path):
    rows = warc.chunked(warc.decided(pages), 5000)
    with pytest.raises(Exception, match="are not its payload"):
        warc.write(rows.withColumn("data", F.when((F.col("page_id") == 12) & (F.col("chunk") == 0), F.lit(b"?")).otherwise(F.col("data"))), str(tmp_path / "bad"))
    warc.write(rows, str(tmp_path / "w"))
    for p in (tmp_path / "w").glob("*.warc.gz"):
        torn = bytearray(p.read_bytes())
        torn[len(torn) // 2] ^= 255
        p.write_bytes(torn)
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path / "w")).count()
    none = warc.write(warc.chunked(warc.decided(pages.limit(0))), str(tmp_path / "none"))
    assert none.count() == 0 and warc.summary(warc.read(spark, str(tmp_path / "none"))).count() == 0


def brute_scatter(vectors):
    xs = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, w = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(w)]
    return xs, n, s, [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(w)] for i in range(w)]


def check_whitening(got, rows):
    """got: rows of the operator; rows: (id, vector) that take part."""
    xs, n, s, integers = brute_scatter([v for _, v in rows])
    w = len(s)
    cov = np.array([[float(Fraction(c, n * n)) for c in r] for r in integers])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, w)
    want = Counter((i, c + 1, n, sum((n * x - t) ** 2 for x, t in zip(r, s))) for (i, _), r in zip(rows, xs) for c in range(k))
    assert Counter((r.vec_id, r.component, r.n, r.deviation if r.deviation_text is None else int(r.deviation_text)) for r in got) == want
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9
    whole = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(r, s)] for r in xs]) @ vectors[:, :k] / np.sqrt(values[:k])
    ids = [i for i, _ in rows]
    for c in range(k):
        mine = {}
        for r in got:
            if r.component == c + 1:
                mine.setdefault(r.vec_id, []).append(r.whitened)
        a = np.array([v for i in dict.fromkeys(ids) for v in sorted(mine[i])])
        plain = {}
        for i, v in zip(ids, whole[:, c]):
            plain.setdefault(i, []).append(v)
        flip = [np.array([v for i in dict.fromkeys(ids) for v in sorted(sign * x for x in plain[i])]) for sign in (1, -1)]
        assert min(np.abs(a - f).max() for f in flip) < 1e-7
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


ODD = [(900, None), (901, []), (902, [1.0] * 3), (903, [float("nan")] + [0.0] * 11), (904, [None] + [0.0] * 11), (905, [float("-inf")] * 12)]


@pytest.mark.parametrize("spread", [0.2, 3e5, 1e12])
def test_whitening(spark, spread):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=12) * np.arange(1, 13) * spread]) for k in range(150)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    d = spark.createDataFrame([(*x, "n", 1) for x in rows + ODD], "vec_id long, embedding array<double>, whitened string, n int").repartition(4)
    check_whitening(whitening.whiten(d).collect(), rows)


def test_whitening_of_few_rows_and_dimensions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [None])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 7.0]) for k in range(9)], schema)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None} and all(abs(r.explained - (r.component == 1)) < 1e-12 for r in flat)
    assert flat[0].identity_error < 1e-9
    wide = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(wide) == 6 and all(r.n == 3 for r in wide)


def test_exact_sums():
    r = np.random.default_rng(1)
    for low, high in ((-5, 5), (-(1 << 31), 1 << 31), (-(1 << 62), 1 << 62)):
        y = r.integers(low, high, size=(300, 4), endpoint=True)
        y[0] = (low, high, -1, 0)
        sums, products = whitening.exact_sums(y)
        x = [[int(v) for v in row] for row in y]
        assert list(sums) == [sum(row[i] for row in x) for i in range(4)]
        assert [[products[i, j] for j in range(4)] for i in range(4)] == [[sum(row[i] * row[j] for row in x) for j in range(4)] for i in range(4)]
        full = np.full((whitening.BLOCK, 2), high)
        assert whitening.exact_sums(full)[1][0, 1] == whitening.BLOCK * high * high


def odd_documents():
    r = np.random.default_rng(2)
    words = ["Alpha", "beta", "Gamma", "der", "Éa", "éa", "İx", "日本", "o'clock", "x1y"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(k, " ".join(r.choice(words[: 8 + 3 * (k % 5)], size=r.integers(1, 30))), ["en", "de"][k % 3 == 0], f"s{k % 5}") for k in range(120)]
    rows += [(200, None, "en", "s0"), (201, "", "fr", "s1"), (202, "only nine of these", "fr", None), (203, "123 456", "fr", "s2"), (204, None, None, None), (205, "  ", None, "s9"), (206, "...", "en", "empty")]
    rows += [(207, "alpha BETA " * 3000, "en", "s1"), rows[3], rows[3], (300, "tie tie", "en", "t1"), (301, "tie tie", "en", "t2")] + [(310 + k, "tie", "en", "t1") for k in range(9)]
    return rows


def brute_audit(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(divergence.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in mine for t in d[2]).items() if n >= least]
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            count[s].update({t: c[t] for t in kept if c[t]})
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + (1_000_000_000 * (c[t] + 2)) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(t, sum(f(share(c, w), share(o, w)) for w in kept)) for t, o in count.items() if t != s]
            terms = [(w, f(share(c, w), share(every, w))) for w in kept if c[w] and share(c, w) > share(every, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for n, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, n))
    return Counter(out)


DOCS = "doc_id long, text string, lang string, source string, term string, n int, shard int"


def test_divergence(spark):
    d = spark.createDataFrame([(*r, "t", 1, 2) for r in odd_documents()], DOCS).repartition(4)
    want = brute_audit(odd_documents())
    assert Counter(map(tuple, divergence.audit(d).collect())) == want
    assert Counter(map(tuple, divergence.audit(d, shards=3, shard_rows=7).collect())) == want
    none = divergence.audit(d.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_in_small_blocks(spark):
    """Texts counted part by part, and counts added block by block and anew."""
    d = spark.createDataFrame([(*r, "t", 1, 2) for r in odd_documents()], DOCS)
    plain, parts = divergence.counted(d), divergence.counted(d, block=50)
    add = lambda df: Counter({(r.lang, r.source, r.term): (r.n, r.docs) for r in df.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()})
    assert add(plain) == add(parts)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(divergence.kept(parts, 2, block=3)) == rows(divergence.kept(plain, 3)) != []


def test_divergence_of_many_sources(monkeypatch):
    r = np.random.default_rng(6)
    names = [f"s{k:02}" for k in range(11)]
    words = pa.table({"lang": ["en"] * 9, "term": [f"w{k}" for k in range(9)], "sources": [names[: k + 2] for k in range(9)], "counts": [r.integers(1, 50, size=k + 2).tolist() for k in range(9)]})
    total = {s: 0 for s in names}
    for row in words.to_pylist():
        for s, n in zip(row["sources"], row["counts"]):
            total[s] += n
    groups = pa.table({"lang": ["en"] * 11, "source": names, "total": list(total.values()), "of_lang": [sum(total.values())] * 11, "v": [9] * 11})
    rows = lambda t: sorted(map(repr, t.to_pylist()))
    want = rows(divergence._shard_sums(words, groups))
    monkeypatch.setattr(divergence, "SOURCES", 4)
    assert rows(divergence._shard_sums(words, groups)) == want and sum("'pair'" in x for x in want) == 55
