"""What a table promises of its columns, as field metadata.

Spark writes a field's metadata into Parquet files and reads it back, so structure goes where a
table goes: through clones, loads and backups. Entries of a field:

    not_null    true: a null is an error
    default     SQL expression of a column that a load leaves out, ``current_timestamp()`` too
    sequence    name of the sequence that numbers a column which a load leaves out
    length      most characters of a text
    comment     text about the column
    key         place in the primary key, from 1
    unique      true: values differ
    references  "table.column" of the parent
    cascade     true: rows go with their parent
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class ColumnMismatch(ValueError):
    """A load has columns that the table lacks, or the other way round."""


def col(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def declare(df: DataFrame, entries: Mapping[str, Mapping]) -> DataFrame:
    """``df`` with entries added to the metadata of its columns."""
    if unknown := set(entries) - set(df.columns):
        raise ColumnMismatch(f"there is no column {', '.join(sorted(unknown))}")
    return df.select(*[col(f.name).alias(f.name, metadata={**f.metadata, **entries.get(f.name, {})}) for f in df.schema])


def keys(structure: StructType) -> list[str]:
    """Columns of the primary key, in its order."""
    return [f.name for f in sorted((f for f in structure if f.metadata.get("key")), key=lambda f: f.metadata["key"])]


def _checked(f: StructField, c: Column) -> Column:
    """A value as the field has it; one that breaks a promise ends the load."""
    c = c.cast(f.dataType)
    if n := f.metadata.get("length"):
        c = F.when(F.length(c) > n, F.raise_error(F.lit(f"{f.name} is longer than {n}"))).otherwise(c)
    if f.metadata.get("not_null") or f.metadata.get("key"):
        c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} is null")))
    return c.alias(f.name, metadata=f.metadata)


def conform(df: DataFrame, structure: StructType, add: bool = False) -> DataFrame:
    """Rows with the columns, types and promises of a table, checked while they are read.

    Columns bind by name. One that the table lacks is an error, or with ``add`` stays as a new
    column. One that the rows lack takes its default; without a default it is an error, or with
    ``add``, where nulls are allowed, null. A value beyond its type is an error.
    """
    have, known = set(df.columns), {f.name for f in structure}
    extra = [f for f in df.schema if f.name not in known]
    if extra and not add:
        raise ColumnMismatch(f"the table has no column {', '.join(f.name for f in extra)}")
    bare = [f.name for f in structure if f.name not in have and "default" not in f.metadata and (not add or f.metadata.get("not_null") or f.metadata.get("key"))]
    if bare:
        raise ColumnMismatch(f"the rows have no column {', '.join(bare)}, which has no default")
    given = lambda f: col(f.name) if f.name in have else F.expr(f.metadata["default"]) if "default" in f.metadata else F.lit(None)
    return df.select(*[_checked(f, given(f)) for f in structure], *[col(f.name).alias(f.name, metadata=f.metadata) for f in extra])


def same_columns(target: DataFrame, source: DataFrame) -> None:
    """Error unless both have the same columns, in any order."""
    if more := [c for c in source.columns if c not in target.columns]:
        raise ColumnMismatch(f"the target has no column {', '.join(more)}")
    if less := [c for c in target.columns if c not in source.columns]:
        raise ColumnMismatch(f"the source has no column {', '.join(less)}")


def describe(structure: StructType) -> list[tuple]:
    """(column_name, ordinal_position, data_type, not_null, default, length, comment) of each column."""
    m = [(f, f.metadata) for f in structure]
    return [(f.name, n, f.dataType.simpleString(), bool(e.get("not_null") or e.get("key")), e.get("default"), e.get("length"), e.get("comment")) for n, (f, e) in enumerate(m, 1)]
