"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import ORACLE_SQL as DIVERGENCE_SQL
from .divergence import op13_divergence
from .langid import op10_langid
from .licenses import ORACLE_SQL as LICENSES_SQL
from .licenses import op2_licenses
from .media import op1_media
from .neardup_vectors import op8_embeddings
from .packing import op7_packing
from .pieces import op6_sentencepiece
from .quality import op5_quality
from .simhash import op3_simhash
from .suffixes import op9_suffixes
from .tokenfiles import op4_tokens
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op11_warc
from .whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_tokens": op4_tokens,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_embeddings": op8_embeddings,
    "op9_suffixes": op9_suffixes,
    "op10_langid": op10_langid,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

# The others hash, tokenise, learn or iterate; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_licenses": LICENSES_SQL, "op11_warc": WARC_SQL, "op13_divergence": DIVERGENCE_SQL}
