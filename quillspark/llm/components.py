"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate with map-side combining and an equi-join whose heavy side can be
split, so a node with very many links isn't gathered anywhere. Each round's links go to a
table in the shared folder, which cuts the lineage; the table before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import discard, written_at


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of each node with a link to another; component is the smallest id that links reach."""
    links, path = written_at(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").union(own.select("hi", F.col("m").alias("lo"))).distinct()
        old = path
        links, path = written_at(small)
        before, mark = mark, _mark(links)
        discard(edges.sparkSession, old)
        if before == mark:
            break
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
