"""Upserts and deletes as rebuilt tables: each returns the table's next state, to be written to a new path and swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], sequence: str | list[str]) -> DataFrame:
    """The last row of each key by an ingest sequence; a whole row wins, as with insert-or-replace."""
    order = [sequence] if isinstance(sequence, str) else sequence
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def replace(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` (one for each key) take the place of those that have their key."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*target.columns))


def ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of ``new`` whose key is free are added."""
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def merge(target: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column | None]) -> DataFrame:
    """Rows with a known key get the columns of ``update``, others are inserted.

    ``update`` names the columns that change; None takes the new value, a column
    expression may use ``old.c`` and ``new.c``.
    """
    old, fresh = target.alias("old"), new.alias("new")
    joined = old.join(fresh, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    known, given = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()
    out = []
    for c in target.columns:
        inserted = F.col(f"new.{c}") if c in new.columns else F.lit(None)
        changed = (inserted if update.get(c) is None else update[c]) if c in update else F.col(f"old.{c}")
        out.append(F.when(known & given, changed).when(known, F.col(f"old.{c}")).otherwise(inserted).alias(c))
    return joined.select(*out)


def counters(target: DataFrame, events: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Adds each key's events to its counter; new keys start at their number."""
    n = events.groupBy(*keys).agg(F.count("*").alias(counter))
    return merge(target, n, keys, {counter: F.coalesce(F.col(f"old.{counter}"), F.lit(0)) + F.col(f"new.{counter}")})


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is still there."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def get_or_create(target: DataFrame, wanted: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """The wanted keys' rows, with defaults for those that aren't there."""
    known = wanted.select(*keys).distinct().join(target.withColumn("_there", F.lit(True)), keys, "left")
    return known.select(*keys, *[F.when(F.col("_there"), F.col(c)).otherwise(defaults.get(c, F.lit(None))).alias(c) for c in target.columns if c not in keys], F.col("_there").isNull().alias("created"))


def next_ids(target: DataFrame, new: DataFrame, id: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest id.

    Ids are gapless in the order's sense without a global sort in one task: rows are
    numbered within ranges and shifted by the ranges' sizes.
    """
    top = target.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    ranged = new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from loreforge.storage import written

    ranged = written(ranged, "ids")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_at", at).join(F.broadcast(sizes.withColumn("_before", before)), "_part").join(F.broadcast(top), F.lit(True))
    return out.withColumn(id, (F.col("_top") + F.col("_before") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_n", "_before", "_top")
