"""An extension: continuous upsert of a stream of changes into a store's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import Store


def latest(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest change of each key, combined before the shuffle."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), version).alias("row")).select("row.*")


def merged(target: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The target with the newest row of each key: a late change with an older version replaces nothing,
    one with an equal version does. Keys with a null never match: such rows are added."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    new = latest(changes.where(~null), keys, version)
    touched = new.select(*keys)
    old = target.join(touched, keys, "left_semi").select(*target.columns)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*target.columns).withColumn("__new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*target.columns), F.struct(version, "__new")).alias("row")).select("row.*")
    rest = target.join(touched, keys, "left_anti").select(*target.columns)
    return rest.unionByName(newest).unionByName(changes.where(null).select(*target.columns))


def start(changes: DataFrame, store: Store, table: str, keys: list[str], version: str, checkpoint: str):
    """Each batch's newest rows are merged into the table, of which only parts with one of its keys are
    rewritten; a repeated batch of whole keys changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not store.exists(table):
            store.write(table, batch.limit(0))
        store.merge(table, batch, keys, lambda old, new: merged(old, new, keys, version))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
