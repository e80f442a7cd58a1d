"""How the sources of a language differ in their words: DuckDB counts and sums over shards, Spark adds.

Documents are counted in blocks (lang, source, term: occurrences and documents) before anything is
shuffled. The counts are dealt into shards by the hash of lang and term; each shard adds them in
DuckDB and keeps the terms that enough of the language's documents have, a row for each term with
all its sources. A second round deals these rows into shards again, each with the totals of the
groups, and sums every pair of sources over its terms in DuckDB; Spark adds the shards' sums and
ranks them. All arithmetic is in integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, saved, table

#: A language's term is kept from this number of its documents on.
KEPT_FROM = 10
SCALE = 1_000_000_000
TOP = 10
#: Bytes of text counted at a time, rows of counts added at a time, and counts of a shard, about.
TEXT_BLOCK, ROW_BLOCK, SHARD = 8 << 20, 200_000, 50_000
#: Sources whose pairs are summed at a time.
SOURCES = 256

# What separates terms, and what is lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _arrow(con, sql: str) -> pa.Table:
    return con.sql(sql).to_arrow_table()


_SPLIT = f"""
SELECT row, term, COUNT(*) AS n FROM (SELECT row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM block) GROUP BY row, term
"""
_COUNT = f"""
SELECT lang, source, term, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS docs FROM ({_SPLIT}) JOIN block USING (row) GROUP BY lang, source, term
UNION ALL SELECT lang, source, '', CAST(0 AS BIGINT), COUNT(*) FROM block GROUP BY lang, source
"""
_SEPARATOR = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text; one that is longer has a slice of its own."""
    length = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(length) - length
    place = np.where(length > size, -1 - np.arange(len(length)), before // size)
    cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(length)]
    for first, past in zip(cuts, cuts[1:]):
        if past > first:
            yield batch.slice(first, past - first)


def _parts(text: str, size: int) -> Iterator[str]:
    """A text in parts that end between terms."""
    first = 0
    while first < len(text):
        end = _SEPARATOR.search(text, min(first + size, len(text)))
        past = end.start() if end else len(text)
        yield text[first:past]
        first = past


def counted(docs: DataFrame, block: int = TEXT_BLOCK) -> DataFrame:
    """COUNTS of blocks of documents: occurrences of a term and documents that have it. The empty term
    has each group's documents. A text beyond a block is counted part by part."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def rows(con, t: pa.Table, sql: str) -> pa.Table:
        con.register("block", t.append_column("row", pa.array(np.arange(t.num_rows, dtype=np.int32))))
        out = _arrow(con, sql)
        con.unregister("block")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for b in batches:
            for piece in _blocks(b, block):
                t = pa.Table.from_batches([piece])
                if t.num_rows > 1 or t.nbytes <= 2 * block:
                    yield from rows(con, t, _COUNT).select(names).to_batches()
                    continue
                con.execute("CREATE OR REPLACE TABLE long (term VARCHAR, n BIGINT)")
                for part in _parts(t.column(2)[0].as_py(), block):
                    con.register("part", rows(con, pa.table({"text": [part]}), _SPLIT))
                    con.execute("INSERT INTO long SELECT term, n FROM part")
                    con.unregister("part")
                con.register("one", t.select([0, 1]))
                found = "SELECT lang, source, term, n, CAST(1 AS BIGINT) AS docs FROM (SELECT term, CAST(SUM(n) AS BIGINT) AS n FROM long GROUP BY term), one"
                yield from _arrow(con, f"{found} UNION ALL SELECT lang, source, '', CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM one").to_batches()
                con.unregister("one")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTS)


_ADD = "SELECT lang, term, source, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(docs) AS BIGINT) AS docs FROM {} GROUP BY ALL"
_KEEP = f"""
SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts FROM ({_ADD.format("added")})
GROUP BY lang, term HAVING term = '' OR SUM(docs) >= {{}}
"""


def kept(counts: DataFrame, shards: int, least: int = KEPT_FROM, block: int = ROW_BLOCK) -> DataFrame:
    """KEPT: a row for each kept term of a language, and one for the empty term, whose sources are all
    groups of the language.

    A shard's rows are added block by block, and what has been added is added up anew whenever it has
    doubled, so that a shard holds about twice its different counts, however often a term was counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        con.execute("CREATE TABLE added (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
        out = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
        held, rows, most = [], 0, 4 * block

        def add() -> int:
            con.register("block", pa.Table.from_batches(held))
            con.execute(f"INSERT INTO added {_ADD.format('block')}")
            con.unregister("block")
            held.clear()
            return con.execute("SELECT COUNT(*) FROM added").fetchall()[0][0]

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= block:
                rows = 0
                if add() > most:
                    con.execute(f"CREATE TABLE anew AS {_ADD.format('added')}")
                    con.execute("DROP TABLE added")
                    con.execute("ALTER TABLE anew RENAME TO added")
                    most = max(4 * block, 2 * con.execute("SELECT COUNT(*) FROM added").fetchall()[0][0])
        if held:
            add()
        yield from _arrow(con, _KEEP.format(least)).cast(out).to_batches()

    return counts.repartition(shards, "lang", "term").mapInArrow(run, KEPT)


_P = f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({{n}} + 2)) // ({{total}} + 2 * CAST({{v}} AS HUGEINT)) AS BIGINT)"
_F = "((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)"


def _dense(block: int) -> str:
    """Shares of a block of sources in each of the shard's terms, also of terms that they don't have."""
    p = _P.format(n="COALESCE(c.n, 0)", total="g.total", v="g.v")
    return f"""SELECT k.lang, k.term, g.source, g.place, {p} AS p FROM (SELECT DISTINCT lang, term FROM c) k JOIN g ON g.lang = k.lang AND g.place // {SOURCES} = {block}
        LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = g.source"""


_PAIRS = f"SELECT a.lang, a.source, b.source AS item, CAST(SUM({_F}) AS BIGINT) AS value FROM da a JOIN db b ON a.lang = b.lang AND a.term = b.term AND a.place < b.place GROUP BY ALL"
_TERMS = f"""
WITH a AS (SELECT c.lang, c.source, c.term, {_P.format(n="c.n", total="g.total", v="g.v")} AS p FROM c JOIN g ON g.lang = c.lang AND g.source = c.source WHERE c.n > 0),
b AS (SELECT c.lang, c.term, {_P.format(n="SUM(c.n)", total="ANY_VALUE(g.of_lang)", v="ANY_VALUE(g.v)")} AS p FROM c JOIN g ON g.lang = c.lang AND g.source = c.source GROUP BY c.lang, c.term)
SELECT a.lang, a.source, a.term AS item, {_F} AS value FROM a JOIN b ON a.lang = b.lang AND a.term = b.term WHERE a.p > b.p
QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY value DESC, item) <= {TOP}
"""
SUMS = "lang string, source string, part string, item string, value long"


def _shard_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of the pairs of sources over a shard's terms, and its first TOP terms of each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not left.num_rows:
        return schema.empty_table()
    con = _engine()
    con.register("rows", left)
    con.register("groups", right)
    con.execute("CREATE TABLE c AS SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM rows")
    con.execute("CREATE TABLE g AS SELECT lang, source, total, of_lang, v, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS place FROM groups WHERE lang IN (SELECT lang FROM c)")
    blocks = con.execute(f"SELECT MAX(place) // {SOURCES} + 1 FROM g").fetchall()[0][0]
    found = [_arrow(con, f"SELECT lang, source, 'term' AS part, item, value FROM ({_TERMS})")]
    for x in range(blocks):
        con.execute(f"CREATE OR REPLACE TABLE da AS {_dense(x)}")
        for y in range(x, blocks):
            con.execute(f"CREATE OR REPLACE TABLE db AS {_dense(y)}")
            found.append(_arrow(con, f"SELECT lang, source, 'pair' AS part, item, value FROM ({_PAIRS})"))
    return pa.concat_tables([t.cast(schema) for t in found])


def audit(docs: DataFrame, shards: int | None = None, shard_rows: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says.

    docs: text, lang, source; other columns are ignored. Nulls are empty strings, repeated rows
    count as often as they occur, documents without a term still make their group known, and an
    empty table gives an empty result. Ties are ranked by the item's bytes. Pairs of sources are
    summed 256 by 256, so a shard's memory does not grow with their number; the work, like the
    result, grows with its square.
    """
    rows = saved(kept(counted(docs), shards or 2 * partitions_for(docs)), "kept")
    words = rows.where("term <> ''")
    per_lang = words.groupBy("lang").agg(F.count("*").alias("v"))
    each = words.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    known = rows.where("term = ''").select("lang", F.explode("sources").alias("source"))
    groups = known.join(each, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "v"])
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"))
    groups = saved(groups.join(of_lang, "lang").select("lang", "source", "total", "of_lang", "v"), "groups")

    size = words.agg(F.sum(F.size("sources"))).first()[0] or 0
    n = max(1, -(-size // shard_rows))
    dealt = words.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int"))
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sums = saved(dealt.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(_shard_sums, SUMS), "sums")

    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(pairs, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = sums.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SQL_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + 2)) // ({{total}} + 2 * {{v}})::HUGEINT"
_SQL_F = "((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
w AS (SELECT id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
per AS (SELECT lang, source, id, term, COUNT(*) AS n FROM w JOIN d USING (id) GROUP BY ALL),
k AS (SELECT lang, term FROM per GROUP BY ALL HAVING COUNT(*) >= {KEPT_FROM}),
c AS (SELECT lang, source, term, SUM(n) AS n FROM per SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, COUNT(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, COALESCE(MAX(t.total), 0) AS total, COALESCE(MAX(v.v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, SUM(n) AS total FROM c GROUP BY ALL) t USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS (SELECT lang, source, term, COALESCE(c.n, 0) AS n, {_SQL_P.format(n="COALESCE(c.n, 0)", total="g.total", v="g.v")} AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {_SQL_P.format(n="SUM(p.n)", total="ANY_VALUE(t.total)", v="ANY_VALUE(t.v)")} AS p
    FROM p JOIN (SELECT lang, SUM(total) AS total, MAX(v) AS v FROM g GROUP BY lang) t USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, SUM({_SQL_F}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(s.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, CAST({_SQL_F} AS BIGINT) AS value FROM p a JOIN q b USING (lang, term) WHERE a.n > 0 AND a.p > b.p)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}
"""
