"""Generation passes: what is left to do, by filter, quota and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import schemas as S

MODES = {"vitals": ("vitals", True), "no_vitals": ("vitals", False), "allergies": ("allergies", True)}


def matches(mode: str, record: str = "record") -> Column:
    """Whether an encounter belongs to a pass; vitals and no_vitals are exact complements."""
    if mode not in MODES:
        raise ValueError(f"unknown pass {mode!r}; there are {sorted(MODES)}")
    resource, has = MODES[mode]
    some = F.coalesce(F.size(F.col(f"{record}.{resource}")) > 0, F.lit(False))
    return some if has else ~some


def non_empty(record: str = "record") -> Column:
    return F.coalesce(sum((F.size(F.col(f"{record}.{r}")) for r in S.RESOURCES), F.lit(0)) > 0, F.lit(False))


def first_rows(rows: DataFrame, n: int, *order: str, small: int = 100_000, bounds: int = 64) -> DataFrame:
    """The first n rows in an order, without gathering them in one task.

    Bounds from a sample of 32 rows for each cut the order into ranges; counts by range say in
    which one the n-th row lies, and that range is cut again until it is small enough to sort.
    """
    types = [rows.schema[c].dataType for c in order]
    key = F.struct(*order)
    at = lambda row: F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, order)])
    whole, open_, size = None, rows, rows.count()
    while size > small and n > 0:
        sample = open_.select(*order).orderBy(F.xxhash64(*order), *order).limit(32 * bounds)
        ranked = sample.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
        cuts = [tuple(r)[: len(order)] for r in ranked.where("_at % 32 = 0").distinct().orderBy(*order).collect()]
        place = sum((F.when(key > at(c), 1).otherwise(0) for c in cuts), F.lit(0))
        counts = {r["_place"]: r["count"] for r in open_.groupBy(place.alias("_place")).count().collect()}
        hit, before = 0, 0
        while hit < len(cuts) and before + counts.get(hit, 0) < n:
            before += counts.get(hit, 0)
            hit += 1
        if counts.get(hit, 0) == size:  # one key has nearly all rows
            break
        taken, n = open_.where(place < hit), n - before
        whole = taken if whole is None else whole.unionByName(taken)
        open_, size = open_.where(place == hit), counts.get(hit, 0)
    last = open_.orderBy(*order).limit(n)
    return last if whole is None else whole.unionByName(last)


def work_list(encounters: DataFrame, done: DataFrame, target: int, *order: str) -> DataFrame:
    """The encounters still to do, the first in an order, as many as the quota leaves; one more at most where it is reached already."""
    already = done.select("encounter_id").distinct()
    left = max(1, target - already.count())
    return first_rows(encounters.join(already, "encounter_id", "left_anti"), left, *order)
