"""The pipeline against a plain version of its stages."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
from millrace.llm import langid, packing, quality
from millrace.llm.common import DOCUMENT_COLUMNS, remainder_of
from tests.llm.test_queries import brute_repeats
from tests.llm.test_similar import brute_shingles, groups_of, jaccard
from tests.llm.test_units import brute_fingerprint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_language(texts, model):
    """Language and posterior of each text: a dictionary of pieces, one word at a time."""
    number, p = {v: n for n, v in enumerate(model["pieces"])}, model["p"]
    longest, known = max(map(len, number)), {}

    def word(w):
        if w not in known:
            sums = [np.ones(p.shape[1])] + [np.zeros(p.shape[1]) for _ in w]
            for i in range(len(w)):
                if w[i] not in number:
                    sums[i + 1] += sums[i] * p[-1]
                for j in range(i + 1, min(len(w), i + longest) + 1):
                    if w[i:j] in number:
                        sums[j] += sums[i] * p[number[w[i:j]]]
            known[w] = np.log(sums[-1])
        return known[w]

    out = {}
    for i, t in texts:
        total = np.zeros(p.shape[1])
        for chunk in t.split():
            if any(c.isalpha() for c in chunk):
                while not chunk[0].isalpha():
                    chunk = chunk[1:]
                while not chunk[-1].isalpha():
                    chunk = chunk[:-1]
                total += word("▁" + chunk.lower())
        best = int(total.argmax())
        out[i] = (model["langs"][best], 1 / sum(math.exp(x - total[best]) for x in total)) if any(c.isalpha() for c in t) else ("und", 0.0)
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    text, lang = dict(zip(docs.doc_id, docs.text)), dict(zip(docs.doc_id, docs.lang))
    taught = [(r.quality, quality._learnt(text[r.doc_id].encode()).dense()) for r in labels if remainder_of(r.doc_id, 5)]
    model = quality.fit([b for _, b in taught], [q for q, _ in taught])
    kept = [(i, t) for i, t in text.items() if model.score([quality.encode(t.encode())])[0] >= quality.THRESHOLD]
    counts: dict = {}
    for i, t in kept:
        if remainder_of(i, 4) != 2 and lang[i] is not None:
            counts.setdefault(lang[i], Counter()).update(t.split())
    language = brute_language(kept, langid.learn(counts, langid.vocabulary(P.path("piece_bpe_32k.model"))))
    kept = [(i, t) for i, t in kept if language[i][0] != "und" and language[i][1] >= corpus_pipeline.LANGUAGE_SCORE]
    fp, sets = {i: brute_fingerprint(t) for i, t in kept}, {i: brute_shingles(t) for i, t in kept}
    near = lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 2 or jaccard(sets[i], sets[j]) >= corpus_pipeline.SIMILARITY
    group = groups_of(list(fp), {i: [j for j in fp if near(i, j)] for i in fp})
    rest = brute_repeats([(i, t) for i, t in kept if group[i] == i])
    final = {i: k.decode("utf-8", "ignore") for i, (k, n, gone, _) in rest.items() if k.decode("utf-8", "ignore") or not gone}
    assert len(text) > len(kept) > len(rest) > 50
    lib = Tokenizer.from_file(packing.default_tokenizer())
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(final)
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array(lib.encode(final[i], add_special_tokens=False).ids + [0], "<u4")
        assert pieces.length.sum() == len(ids)
        assert pieces.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(pieces.start, pieces.length)]


def test_near_duplicates_are_decided_by_rows(spark):
    """Repeated, shared and missing ids: the exact rows that stay."""
    r = random.Random(1)
    w, q, x, y = (" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(0, w), (1, w), (1, q), (1, q), (None, w), (None, x), (None, x), (2, y), (2, y + " more"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((d.doc_id, d.text) for d in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    one_of_two = [Counter({(2, y): 1}), Counter({(2, y + " more"): 1})]
    assert got - Counter({(0, w): 1, (1, q): 1, (None, x): 1, (3, None): 1}) in one_of_two


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a few plain words of text", "en", None, 3), (2, "a" * 300, "en", None, 3), (None, "a few plain words of text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs.selectExpr("*", "1 AS starts", "2 AS ends", "3 AS rid", "'x' AS component")  # not carried on
    for d in (docs, more, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, SF).columns == list(DOCUMENT_COLUMNS)
            assert stage(spark, d, SF).count() <= d.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, d, SF).count() > 0) == (d.count() > 0)
    cut = corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect()
    assert Counter((d.doc_id, d.text, d.n_chars) for d in cut) == Counter([(None, None, 0), (1, "", 0), (1, "", 0), (2, rows[3][1], 25), (2, "a", 1), (None, rows[3][1], 25)])
    assert {d.text for d in corpus_pipeline.filter_language(spark, docs, SF).collect()} <= {t for _, t, *_ in rows if t and re.search("[a-z]", t)}


def test_stages_read_few_texts_at_once(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    docs, before = spark.createDataFrame([], SCHEMA), spark.conf.get(key)
    try:
        for set_to, want in (("4096", 512), ("100", 100)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(key, set_to)
                stage(spark, docs, SF)
                assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_stages_send_few_bytes_at_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, before = spark.createDataFrame([], SCHEMA), spark.conf.get(key)
    long = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    sizes = lambda batches: (pa.record_batch([[b.num_rows], [b.nbytes]], ["rows", "bytes"]) for b in batches)
    try:
        for set_to, want in (("67108864b", 8 << 20), ("1g", 8 << 20), ("1m", 1 << 20)):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(key, set_to)
                stage(spark, docs, SF)
                assert corpus_pipeline._size(spark.conf.get(key)) == want
            got = long.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in got) == 40 and max(r.bytes for r in got) <= want + 1_000_100
    finally:
        spark.conf.set(key, before)
