"""From raw documents to packed sequences: STAGES in order, each reading what the one before wrote.

Every stage takes nulls in any column, repeated rows, ids that several rows share or that are null,
texts of any length and empty tables, and decides on each row by itself. All but the last return the
columns of documents; others that a table may have are not carried on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, packing, quality, simhash, suffixes
from millrace.llm.common import DOCUMENT_COLUMNS, numbered, saved, table

#: A language is taken as known from this posterior on.
LANGUAGE_SCORE = 0.5

#: Texts are near copies from this Jaccard similarity of their five-word shingles on.
SIMILARITY = 0.8

#: Rows of a Parquet table that a stage's tasks read at once. Spark's 4096 are meant for short values: of
#: texts they make arrays of many MB, by which an executor's heap grows far beyond what it holds.
READ_ROWS = 512

#: Bytes of rows that tasks hand to Python at once. Spark's 64 MB are there several times: in the executor's
#: JVM, in the Python process and, as that takes it apart, in strings.
SENT_BYTES = 8 << 20

#: Of the encoder's tables, what packing fills here, where executors have had four other stages before it.
TABLES = 0.25


def _size(value: str) -> int:
    """Bytes, from a setting as Spark takes it: 67108864b, 16m, 1gb."""
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", value.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def _reads_texts(spark: SparkSession) -> None:
    """Lets the session read at most READ_ROWS and send at most SENT_BYTES at once, also the rows that a
    stage hands on unsaved."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _size(spark.conf.get(key)) > SENT_BYTES:
        spark.conf.set(key, str(SENT_BYTES))


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labelled ones, does not reject.

    A null text is scored as empty, a text of any length by all its passages; repeated rows and rows
    without an id are decided on each, and of an empty table nothing is left.
    """
    _reads_texts(spark)
    docs = _columns(docs)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, model).where(F.col("quality_score") >= quality.THRESHOLD))


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: with a letter, and a posterior of at least one half.

    The posterior is over the languages learnt, so it is near 1 for any longer text. Null, empty and
    letterless texts go; a null lang teaches nothing and is no reason to go. Repeated rows and rows
    without an id are decided on each, and of an empty table nothing is left.
    """
    import public_tokenizers

    _reads_texts(spark)
    docs = _columns(docs)
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    got = langid.identify(docs, model)
    return _columns(got.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LANGUAGE_SCORE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Linked are fingerprints within two bits, as in op3, and texts of SIMILARITY or more. Rows are
    decided on one by one: of repeated rows one stays, of rows that share an id and differ each is a
    document of its own, and rows without an id take part and give way to any other.
    """
    _reads_texts(spark)
    docs = numbered(_columns(docs), nulls_first=False)
    gone = simhash.groups(docs.select(F.col("__row").alias("doc_id"), "text"), SIMILARITY).select(F.col("node").alias("__row"))
    return _columns(docs.join(gone, "__row", "left_anti"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that occurred before; documents of which nothing is left go.

    Characters that a cut runs through are dropped with it. n_chars is counted anew. A text that had
    nothing to cut stays, null and empty ones too; of repeated rows the first keeps its text and the
    others, from 100 bytes on, go; rows without an id come before all others. An empty table stays empty.
    """
    _reads_texts(spark)
    docs = _columns(docs)
    return suffixes.cut_texts(docs).where((F.col("text") != "") | (F.col("n_removed") == 0)).select(
        "doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    _reads_texts(spark)
    return packing.pack(docs, packing.default_tokenizer(), share=TABLES)


STAGES = [
    ("quality classifier", filter_quality),
    ("language ID", filter_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"stage{n + 1}")
    return docs


#: Learnt models, hash fingerprints and tokenisers are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None
