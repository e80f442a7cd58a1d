"""Load strategies as functions of target and source: what the target is after the load.

Columns bind by name, and a source with other columns than the target's is an error. A key that a load would leave doubled is an error, as in a database that
enforces it; checks are one combined aggregate over the keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.structure import same_columns


class KeyConflict(ValueError):
    """A load would repeat a key."""


def where_filter(source: DataFrame, condition: str | None) -> DataFrame:
    return source.where(F.expr(condition)) if condition else source


def incremental_filter(source: DataFrame, column: str | None, mark, condition: str | None = None) -> DataFrame:
    """Rows after the mark; without a column or a mark the condition decides."""
    return source.where(F.col(column) > F.lit(mark)) if column and mark is not None else where_filter(source, condition)


def high_water(source: DataFrame, column: str):
    """The mark for the next incremental load."""
    return source.agg(F.max(column)).first()[0]


def check_keys(df: DataFrame, keys: list[str], what: str = "source") -> None:
    """Error if a whole key occurs twice; keys that hold a null never match."""
    sound = df.dropna(subset=keys) if keys else df
    if keys and sound.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise KeyConflict(f"{what} repeats keys of {', '.join(keys)}")


def check_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> None:
    """Error if a key of the source is repeated or already in the target. The target's keys are only
    looked up, not grouped."""
    check_keys(source, keys)
    if target.select(*keys).join(source.select(*keys), keys, "left_semi").limit(1).count():
        raise KeyConflict(f"target has keys of the source: {', '.join(keys)}")


def full(target: DataFrame, source: DataFrame) -> DataFrame:
    same_columns(target, source)
    return source.select(*target.columns)


def append(target: DataFrame, source: DataFrame, keys: list[str] | None = None, check: bool = False) -> DataFrame:
    """Both as a bag."""
    same_columns(target, source)
    out = target.unionByName(source)
    if check and keys:
        check_keys(out, keys, "target with source")
    return out


def incremental(target: DataFrame, source: DataFrame, column: str | None, mark, keys: list[str] | None = None, on_conflict: str = "error", condition: str | None = None) -> DataFrame:
    """Rows after the mark appended. on_conflict: "error", "upsert", or "ignore" for no check."""
    new = incremental_filter(source, column, mark, condition)
    if on_conflict == "upsert":
        return upsert(target, new, keys)
    return append(target, new, keys, on_conflict == "error")


def upsert(target: DataFrame, source: DataFrame, keys: list[str] | None, check: bool = False) -> DataFrame:
    """Source rows replace target rows of equal key, others are added; without keys an append.

    If every column is in the key there is nothing to update: only absent rows are added.
    """
    if not keys:
        return append(target, source)
    same_columns(target, source)
    if check:
        check_keys(source, keys)
    if set(keys) == set(target.columns):
        return target.unionByName(source.join(target, keys, "left_anti"))
    return source.select(*target.columns).unionByName(target.join(source.select(*keys), keys, "left_anti").select(*target.columns))


def delete_conflicting(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target without rows whose key is in the source."""
    return target.join(source.select(*keys), keys, "left_anti")


STRATEGIES = ("full", "append", "incremental", "upsert")


def apply(mode: str, target: DataFrame, source: DataFrame, keys: list[str] | None = None, column: str | None = None, mark=None, condition: str | None = None) -> DataFrame:
    """The strategy by name; an unknown one is an error."""
    if mode == "full":
        return full(target, where_filter(source, condition))
    if mode == "append":
        return append(target, where_filter(source, condition), keys, True)
    if mode == "incremental":
        return incremental(target, source, column, mark, keys, condition=condition)
    if mode == "upsert":
        return upsert(target, where_filter(source, condition), keys, True)
    raise ValueError(f"unknown mode {mode!r}; one of {', '.join(STRATEGIES)}")
