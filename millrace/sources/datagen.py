"""The volume table: generated rows, the same for the same numbers on any number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import to_int_half_even


def salted(salt: str):
    return F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"))


def fraction(salt: str):
    """A number from 0 to 1 that depends on id and salt alone."""
    return F.conv(F.substring(salted(salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def json_column():
    array = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.md5(F.concat(F.col("id").cast("string"), F.lit("a"), i.cast("string")).cast("binary")))
    return F.to_json(F.struct("id", *[salted(f"d{n}").alias(f"data{n}") for n in range(1, 6)], array.alias("array_data"), F.struct(F.lit("2024-01-01").alias("created"), F.lit("2024-01-01").alias("updated"), to_int_half_even(fraction("v") * 10).alias("version")).alias("metadata")))


def generate(spark: SparkSession, n: int) -> DataFrame:
    """Rows for the numbers from 1 to n."""
    return generate_for(spark.range(1, n + 1))


def generate_for(ids: DataFrame) -> DataFrame:
    """(id, large_data of 2048 characters, json_data, binary_data of 32 bytes) for each id."""
    return ids.select("id", F.repeat(F.concat(salted("x"), salted("y")), 32).alias("large_data"), json_column().alias("json_data"), F.unhex(F.concat(salted("b"), salted("c"))).alias("binary_data"))
