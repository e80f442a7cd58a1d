"""JSON as a VARIANT column: parsed once, stored in binary form, looked into by path.

As in PostgreSQL's JSONB, of a key that an object repeats the last value stays, the order in which
keys were written is lost, and so are blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys(spark: SparkSession) -> None:
    """The session parses objects that repeat a key; without this they are an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parsed(df: DataFrame, column: str, lenient: bool = False) -> DataFrame:
    """A text column as VARIANT; text that isn't JSON is an error, or null if lenient."""
    allow_repeated_keys(df.sparkSession)
    return df.withColumn(column, F.try_parse_json(column) if lenient else F.parse_json(F.col(column)))


def get(column: str, path: str, kind: str) -> Column:
    """The value at a path such as ``$.metadata.version``; null where there is none or it is of another kind."""
    return F.try_variant_get(F.col(column), path, kind)


def text(column: str) -> Column:
    """As JSON without blanks, keys in order of their bytes."""
    return F.to_json(F.col(column))


def jsonb_text(column: str) -> Column:
    """An object as PostgreSQL prints JSONB: shorter keys first, then by bytes, a blank after colons and
    commas between its entries; values that are objects or arrays themselves are printed as ``text``
    does. Anything but an object is printed as ``text`` does."""
    entries = F.map_entries(F.try_variant_get(F.col(column), "$", "map<string,variant>"))
    order = lambda a, b: F.when(F.octet_length(a["key"]) != F.octet_length(b["key"]), F.octet_length(a["key"]) - F.octet_length(b["key"])).when(a["key"] < b["key"], -1).otherwise(1)
    one = lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), F.to_json(e["value"]))
    printed = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries, order), one), ", "), F.lit("}"))
    return F.when(F.schema_of_variant(F.col(column)).startswith("OBJECT"), printed).otherwise(text(column))
