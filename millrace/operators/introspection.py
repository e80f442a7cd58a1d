"""Look-ups over a catalog (``sources/catalog_source.py``), and keys found in the data."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import quote_identifier

#: Columns that tell when a row changed, best first.
CHANGE_COLUMNS = ("updated_at", "modified_at", "last_updated", "created_at")
TIME_TYPES = ("timestamp", "timestamp_ntz", "timestamp without time zone", "timestamp with time zone", "date")


def list_tables(tables: DataFrame, schema: str = "public") -> DataFrame:
    return tables.where((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")).select("table_name").orderBy("table_name")


def table_columns(columns: DataFrame, schema: str = "public") -> DataFrame:
    c = columns.where(F.col("table_schema") == schema)
    return c.groupBy("table_name").agg(F.expr("listagg(column_name, ', ') WITHIN GROUP (ORDER BY ordinal_position)").alias("columns"))


def key_columns(columns: DataFrame, constraints: DataFrame, tables: DataFrame | None = None, schema: str = "public") -> DataFrame:
    """(table_name, pos, column_name) of primary keys, positions from 1.

    A constraint meets its table, if ``tables`` are given only a base table, and the columns of the
    table whose number is any of its key's; the place in the key comes from the key unnested with its
    order.
    """
    p = constraints.where((F.col("contype") == "p") & (F.col("table_schema") == schema)).select("table_schema", "table_name", "conkey")
    if tables is not None:
        p = p.join(tables.where("table_type = 'BASE TABLE'").select("table_schema", "table_name"), ["table_schema", "table_name"])
    met = columns.join(p, (columns["table_schema"] == p["table_schema"]) & (columns["table_name"] == p["table_name"]) & F.array_contains(p["conkey"], columns["ordinal_position"]))
    met = met.select(p["table_name"], "column_name", "ordinal_position", F.posexplode("conkey").alias("pos", "attnum"))
    return met.where("attnum = ordinal_position").select("table_name", (F.col("pos") + 1).alias("pos"), "column_name")


def primary_key_columns(columns: DataFrame, constraints: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    return key_columns(columns, constraints, tables).groupBy("table_name").agg(F.expr("listagg(column_name, ', ') WITHIN GROUP (ORDER BY pos)").alias("key_columns"))


def update_columns(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """For each table the assignments of an upsert: every column that is not in the key."""
    rest = columns.join(key_columns(columns, constraints).select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    q = quote_identifier(F.col("column_name"))
    return rest.withColumn("set", F.format_string("%s = EXCLUDED.%s", q, q)).groupBy("table_name").agg(F.expr("listagg(`set`, ', ') WITHIN GROUP (ORDER BY ordinal_position)").alias("assignments"))


def detect_timestamp_column(columns: DataFrame, names: tuple[str, ...] = CHANGE_COLUMNS) -> DataFrame:
    """For each table the best of ``names`` that has a time type."""
    rank = F.lit(len(names) + 1)
    for n, c in reversed(list(enumerate(names, 1))):
        rank = F.when(F.col("column_name") == c, n).otherwise(rank)
    found = columns.where(F.col("column_name").isin(*names) & F.col("data_type").isin(*TIME_TYPES))
    return found.groupBy("table_name").agg(F.min_by("column_name", rank).alias("column_name"))


def referenced_tables(constraints: DataFrame) -> DataFrame:
    return constraints.where("contype = 'f' AND table_name <> ref_table").select("ref_table").distinct()


def constraint_list(constraints: DataFrame) -> DataFrame:
    """(table_name, conname, contype, definition)."""
    cols = F.array_join("columns", ", ")
    kind = F.when(F.col("contype") == "p", "PRIMARY KEY").when(F.col("contype") == "u", "UNIQUE").otherwise("FOREIGN KEY")
    parent = F.concat(F.lit(" REFERENCES "), F.col("ref_table"), F.lit("("), F.array_join("ref_columns", ", "), F.lit(")"))
    tail = F.when(F.col("contype") == "f", F.concat(parent, F.coalesce(F.concat(F.lit(" ON DELETE "), F.col("on_delete")), F.lit("")))).otherwise("")
    return constraints.where("contype <> 'c'").select("table_name", "conname", "contype", F.concat(kind, F.lit(" ("), cols, F.lit(")"), tail).alias("definition"))


def edges(constraints: DataFrame) -> list[tuple[str, str]]:
    """(child, parent) of foreign keys between different tables."""
    found = constraints.where("contype = 'f' AND table_name <> ref_table").select("table_name", "ref_table").distinct()
    return sorted((r.table_name, r.ref_table) for r in found.collect())


def _sound(df: DataFrame, columns: list[str]) -> bool:
    """Whether the columns have no null and no repeated values."""
    n = df.groupBy(*columns).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.bool_or(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))), F.lit(False)).alias("null")).first()
    return n.most <= 1 and not n.null


def primary_key(df: DataFrame, width: int = 2) -> list[str]:
    """The fewest first columns, up to ``width``, that hold no null and no value twice; none: []."""
    for n in range(1, width + 1):
        if n <= len(df.columns) and _sound(df, df.columns[:n]):
            return df.columns[:n]
    return []


def stem(column: str) -> str:
    """A column's name without its table's letter: c_custkey and o_custkey are both custkey."""
    return re.sub(r"^[a-z]_", "", column)


def discover(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, dict]]:
    """Metadata for ``structure.declare`` of each table, found in the data: the primary key, and foreign
    keys, columns named as the one-column key of another table whose values all occur there."""
    keys = {t: primary_key(df) for t, df in tables.items()}
    out = {t: {c: {"key": n} for n, c in enumerate(k, 1)} for t, k in keys.items()}
    for child, df in tables.items():
        for parent, key in keys.items():
            for c in df.columns if parent != child and len(key) == 1 else ():
                if stem(c) == stem(key[0]) and df.select(c).dropna().join(tables[parent].select(F.col(key[0]).alias(c)), c, "left_anti").isEmpty():
                    out[child].setdefault(c, {})["references"] = f"{parent}.{key[0]}"
    return out
