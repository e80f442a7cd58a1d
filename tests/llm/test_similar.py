"""Near copies by five-word shingles against all pairs."""

import random

import corpus_pipeline
from millrace.llm import similar, simhash
from millrace.llm.common import components

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups_of(ids, linked):
    group = {i: i for i in ids}
    while True:
        new = {i: min(group[j] for j in [i, *linked.get(i, ())]) for i in ids}
        if new == group:
            return group
        group = new


def brute_groups(texts, similarity=0.8):
    sets, linked = {i: brute_shingles(t) for i, t in texts}, {}
    for i in sets:
        linked[i] = [j for j in sets if j != i and jaccard(sets[i], sets[j]) >= similarity]
    return groups_of(sets, linked)


def changed(words, share, rng, other):
    return [other + str(rng.random()) if rng.random() < share else w for w in words]


def test_stage_drops_near_copies_of_similarity_0_8(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    copy, other = list(words), list(words)
    for at in range(30, 390, 50):  # 40 of 396 shingles: similarity 0.82
        copy[at] = "x"
    for at in range(5, 400, 20):  # 100 of 396 shingles: similarity 0.6
        other[at] = "y"
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate((words, copy, other))]
    assert 0.8 <= jaccard(brute_shingles(rows[0][1]), brute_shingles(rows[1][1])) < 0.9
    assert jaccard(brute_shingles(rows[0][1]), brute_shingles(rows[2][1])) < 0.7
    assert bin(simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).count("1") > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 2]


def test_edges_link_what_all_pairs_link(spark):
    """Generated documents, groups with members on either side of the limit, odd rows."""
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = max(i for i, _ in rows)
    for size in (3, 8, 40, 300):
        base = [f"v{rng.randrange(9000)}" for _ in range(size)]
        for k in range(25):
            n += 1
            rows.append((n, " ".join(changed(base, 0.04 * rng.random(), rng, "z"))))
    rows += [(n + 1, ""), (n + 2, " \t "), (n + 3, "One two"), (n + 4, "one\ntwo"), (n + 5, None)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[3]], "doc_id long, text string")
    want = brute_groups(rows)
    got = {r.node: r.component for r in components(similar.edges(docs)).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert similar.edges(docs.limit(0)).count() == 0


def test_texts_and_keys_are_not_shuffled_without_need(spark, monkeypatch):
    """Few texts share a key: the others stay where they are, and keys meet once."""
    plans, save = {}, similar.saved

    def saved(df, name="data", path=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(df, name, path)

    monkeypatch.setattr(similar, "saved", saved)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert similar.edges(docs).count() > 0
    assert {n: plans[n].count("Exchange hashpartitioning") for n in ("sets", "leaders")} == {"sets": 0, "leaders": 1}
