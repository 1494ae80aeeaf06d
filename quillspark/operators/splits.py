"""Entity-atomic splits: seeded order by a hash of the entity, running quotas by two-level sums.

A running sum over all entities would go through one task; instead sums by hash prefix are
prefixed, and only the order within a prefix is settled by a window. All rows of an entity
go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, key: Column, purpose: str = "") -> Column:
    """A hash of seed and key, as 32 hex digits; orders by it are shuffles that SQL can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{purpose}" if purpose else "")).cast("binary"))


def fraction(digest: Column) -> Column:
    """A number from 0 to 1 made of a digest's first 8 hex digits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def running_sum(df: DataFrame, order: str, tie: str, value: str, out: str, digits: int = 3) -> DataFrame:
    """df with the sum of `value` over all rows before, in the order of a hex digest (and tie)."""
    with_prefix = df.withColumn("_prefix", F.substring(order, 1, digits))
    sums = with_prefix.groupBy("_prefix").agg(F.sum(value).alias("_sum"))
    before = sums.select("_prefix", F.coalesce(F.sum("_sum").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_prefix").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    return with_prefix.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, "_prefix").withColumn(out, F.col("_before") + F.col("_inside")).drop("_prefix", "_inside", "_before")


def split_by_entity(rows: DataFrame, entity: str, targets: dict[str, int], seed: int) -> DataFrame:
    """rows with `split`: held-out splits fill in the order given until they hold their target, by whole entities; the rest is train.

    An entity starts the next split as soon as the one before is full. Where a split ends is
    the first running count that reaches its target, counted from where it began.
    """
    counts = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).withColumn("_order", seeded(seed, F.col(entity)))
    placed = running_sum(counts, "_order", entity, "_n", "_cum")
    ends: list[tuple[str, int, int]] = []
    start = 0
    for name, target in targets.items():
        if name == "train" or target <= 0:
            continue
        end = placed.where(F.col("_cum") >= start + target).agg(F.min("_cum")).first()[0]
        ends.append((name, start, end if end is not None else (1 << 62)))
        if end is None:
            break
        start = end
    split = F.lit("train")
    for name, lo, hi in reversed(ends):
        split = F.when((F.col("_cum") >= lo) & (F.col("_cum") < hi), F.lit(name)).otherwise(split)
    return rows.join(placed.select(entity, split.alias("split")), entity)


def reserve_slice(rows: DataFrame, entity: str, wanted: Column, target: int, seed: int) -> DataFrame:
    """rows with `held`: whole entities that have a wanted row, in seeded order, until the slice has `target` wanted rows."""
    if target <= 0:
        return rows.withColumn("held", F.lit(False))
    counts = rows.groupBy(entity).agg(F.count_if(wanted).alias("_n")).where("_n > 0").withColumn("_order", seeded(seed, F.col(entity)))
    held = running_sum(counts, "_order", entity, "_n", "_cum").where(F.col("_cum") < target).select(entity, F.lit(True).alias("held"))
    return rows.join(held, entity, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def two_way(rows: DataFrame, entity: str, held_rows: int, seed: int) -> DataFrame:
    """rows with `split`: val up to its target, the rest train."""
    return split_by_entity(rows, entity, {"val": held_rows}, seed)
