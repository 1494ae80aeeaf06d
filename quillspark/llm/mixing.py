"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a seeded, shuffled order. A document's
virtual finish time is the running sum of its source's words (its own included,
earlier passes over the source included) over the source's target. The mix is the
global order by finish time, truncated where the budget, all words, is used up.

Running sums never put a source into one task: sizes are first added up by
(source, hash bucket), only those sums are prefixed by source, and the exact order
is then settled inside each bucket. The cut is found the same way: sums by
finish-time bucket, then an exact order inside the one bucket that holds the cut.

Nulls: a null text has size 0, a null source is a source of its own (last), a null
doc_id sorts first. Rows of one doc_id and size go by a hash of their text. Rows of size 0 take 0 words. Repeated rows count each. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import WORD, table, written

WEIGHTS, MAX_COPIES, PER_BUCKET = (5, 2, 1), 3, 2000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): a share by weight, held at max_copies times the source, the excess reshared.

    Water-filling in closed form: by rising cap over weight, the level offered to each
    source by what the earlier ones leave peaks at the common level.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sums.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(past), F.lit(0))).cast("double") / F.sum("weight").over(rest))
    level = F.max("level").over(whole)
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _bucket(seed: str, digits: int) -> Column:
    """The bucket of a row: the first digits of its place in the shuffle.

    All rows without doc_id share one place. They get buckets of their own by size and text,
    which sort between those of the rows before and after that place.
    """
    prefix, void = F.substring("shuffle", 1, digits), F.md5(F.lit(f"{seed}null").cast("binary"))
    own = F.concat(void, F.lit(":"), F.lpad(F.col("size").cast("string"), 12, "0"), F.lit(":"), F.lpad(F.pmod("tie", F.lit(256)).cast("string"), 3, "0"))
    after = (prefix == F.substring(void, 1, digits)) & (F.col("shuffle") > void)
    return F.when(F.col("doc_id").isNull(), own).when(after, F.concat(prefix, F.lit("g"))).otherwise(prefix)


def mix_sources(docs: DataFrame, *keep: str, seed: str = "mix", weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, key: str = "doc_id") -> DataFrame:
    """docs(doc_id, text, source, keep...) -> doc_id, size, source, source_size, target, keep..., taken."""
    kept = F.struct(*keep, F.lit(True).alias("_")).alias("kept")
    sizes = docs.select(F.col(key).alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"), kept)
    sizes = written(sizes)
    n, budget = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    targets = written(source_targets(sizes, weights, max_copies))
    digits = max(1, math.ceil(math.log(max(n, 2) / PER_BUCKET, 16))) if n > PER_BUCKET else 1
    shuffled = sizes.withColumn("shuffle", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))).withColumn("bucket", _bucket(seed, digits))
    by_bucket = shuffled.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    starts = start.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queue = shuffled.withColumn("within", F.sum("size").over(inside)).alias("q").join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
    queue = written(queue.select("doc_id", "size", "q.source", "source_size", "target", "shuffle", "kept", (F.col("before") + F.col("within")).alias("done")))

    def finish(copy):
        return (F.col("done") + F.col("source_size") * copy).cast("double") / F.col("target")

    passes = F.greatest(F.lit(1), F.least(F.lit(max_copies), F.ceil(F.col("target") / F.col("source_size"))))
    slots = queue.where("size > 0 and target > 0").select("size", "shuffle", "doc_id", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))).alias("copy"), "done", "source_size", "target").withColumn("finish", finish(F.col("copy"))).withColumn("tick", F.floor(F.col("finish") * max(1, (n or 0) // PER_BUCKET)))
    ticks = slots.groupBy("tick").agg(F.sum("size").alias("words"))

    def first_over(rows: DataFrame, step: str, before: int):
        """The first step at which the words reach past the budget, and the words before it."""
        upto = rows.withColumn("upto", F.sum("words").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)) + before)
        return upto.where(F.col("upto") > (budget or 0)).orderBy(step).select(F.col(step).alias("tick"), (F.col("upto") - F.col("words")).alias("before")).first()

    # two levels, so that no task sees more than the square root of the ticks or so
    wide = F.floor(F.col("tick") / PER_BUCKET)
    cut = first_over(ticks.groupBy(wide.alias("wide")).agg(F.sum("words").alias("words")), "wide", 0)
    cut = cut and first_over(ticks.where(wide == cut["tick"]), "tick", cut["before"])
    if cut is None:
        last = None
    else:
        order = ["finish", "shuffle", "doc_id", "size", "copy"]
        within = slots.where(F.col("tick") == cut["tick"]).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + cut["before"])
        last = within.where(F.col("upto") <= budget).orderBy(*[F.col(c).desc() for c in order]).select(*order).first() or slots.where(F.col("tick") < cut["tick"]).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
    taken = F.lit(0)
    for copy in range(max_copies):
        if cut is None:
            fits = F.lit(copy) < passes
        elif last is None:
            fits = F.lit(False)
        else:
            this = F.struct(finish(F.lit(copy)).alias("finish"), "shuffle", "doc_id", "size", F.lit(copy).alias("copy"))
            fits = (F.lit(copy) < passes) & (this <= F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["shuffle"]).alias("shuffle"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["copy"]).alias("copy")))
        taken = taken + F.when(fits, F.lit(1)).otherwise(F.lit(0))
    some = (F.col("size") > 0) & (F.col("target") > 0)
    return queue.select("doc_id", "size", "source", "source_size", "target", *[F.col("kept")[k].alias(k) for k in keep], F.when(some, F.col("size") * taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS shuffle FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
levels AS (
  SELECT *, CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (max(level) OVER ()) * weight) AS target FROM levels),
queue AS (
  SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
slots AS (
  SELECT doc_id, size, shuffle, copy, CAST(done + copy * source_size AS DOUBLE) / target AS finish
  FROM queue, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0 AND copy < ceil(target / source_size)),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffle, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM slots),
copies AS (SELECT doc_id, count(*) AS n FROM placed WHERE upto <= (SELECT sum(size) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, size, source, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN copies c ON q.doc_id = c.doc_id
"""
