"""Corpus statistics: drop rates, composition, diversity, percentiles, key counts, system pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S


def share(part: Column, whole: Column) -> Column:
    """part / whole to four places, 0 where there is nothing."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), 4), F.lit(0.0))


def drop_rates(checked: DataFrame) -> DataFrame:
    """raw, kept, and what was dropped for missing and for invented facts, which overlap: one scan."""
    missing, invented = F.size("missing") > 0, F.size("invented") > 0
    n = checked.agg(F.count(F.lit(1)).alias("raw_pairs"), F.count_if(~missing & ~invented).alias("kept_pairs"), F.count_if(missing).alias("_m"), F.count_if(invented).alias("_i"))
    return n.select("raw_pairs", "kept_pairs", share(F.col("raw_pairs") - F.col("kept_pairs"), F.col("raw_pairs")).alias("drop_rate"), share(F.col("_m"), F.col("raw_pairs")).alias("drop_rate_missing"), share(F.col("_i"), F.col("raw_pairs")).alias("drop_rate_invented"))


def rows_by_resource(rows: DataFrame, record: str = "label") -> DataFrame:
    return rows.agg(*[F.count_if(F.size(f"{record}.{r}") > 0).alias(r) for r in S.RESOURCES])


def ngrams(words: DataFrame, *sizes: int) -> DataFrame:
    """(words: list) -> n, p, q of each n words that follow each other, for each size: 128 bits that stand for them.

    Places and sizes are exploded, and the words looked up, inside code generation: no list of n-grams is made.
    """
    placed = words.where(F.size("words") > 0).select("words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    placed = placed.select("words", "i", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.col("i") + F.col("n") <= F.size("words"))
    p = q = None
    for n in sizes:
        own = [F.get("words", F.col("i") + k) for k in range(n)]
        p, q = ((F if c is None else c).when(F.col("n") == n, F.xxhash64(*x)) for c, x in ((p, own), (q, [F.lit(n), *own[::-1]])))
    return placed.select("n", p.alias("p"), q.alias("q"))


def distinct_n(docs: DataFrame, text: str, *sizes: int) -> DataFrame:
    """n, distinct_ratio for each size: different n-grams of lower-cased words over all n-grams of the corpus.

    One scan for all sizes. N-grams are shuffled as 128-bit hashes, counted within each task before.
    """
    words = docs.select(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "").alias("words"))
    grams = ngrams(words, *sizes)
    by_n = grams.groupBy("n", "p", "q").agg(F.count(F.lit(1)).alias("c")).groupBy("n").agg((F.count(F.lit(1)) / F.sum("c")).alias("found"))
    every = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    return every.join(by_n, "n", "left").select("n", F.coalesce("found", F.lit(0.0)).alias("distinct_ratio"))


def nearest_rank(values: DataFrame, group: str, value: str, *shares: float) -> DataFrame:
    """Percentiles that are observed values: the element at ceil(p n). An empty group has none."""
    return values.groupBy(group).agg(*[F.expr(f"coalesce(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}), 0.0D)").alias(f"p{round(100 * p)}") for p in shares])


def throughput(runs: DataFrame, group: str, seconds: str, tokens_in: str, tokens_out: str, hourly: float) -> DataFrame:
    """Requests and tokens a second, tokens a note, and the cost of a million notes, from the rounded rate."""
    g = runs.groupBy(group).agg(F.count(F.lit(1)).alias("notes"), F.sum(seconds).alias("_s"), F.sum(tokens_in).alias("_i"), F.sum(tokens_out).alias("_o"))
    g = g.withColumn("notes_per_s", F.round(F.col("notes") / F.nullif("_s", F.lit(0.0)), 3))
    return g.select(group, "notes", "notes_per_s", F.round(F.col("_i") / F.col("notes"), 1).alias("prompt_tokens_per_note"), F.round(F.col("_o") / F.nullif("_s", F.lit(0.0)), 1).alias("output_tokens_per_s"), F.round(1e6 / F.nullif("notes_per_s", F.lit(0.0)) / 3600 * hourly, 2).alias("usd_per_million"))


def key_counts(rows: DataFrame, json: str) -> DataFrame:
    """key, n of the top-level keys of JSON objects, most frequent first; ties by key."""
    keys = rows.select(F.explode(F.json_object_keys(json)).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def coverage(keys: DataFrame, key: str = "key") -> DataFrame:
    """resource, n_hits: how many keys stand for each resource; the table of words is fixed and small."""
    low = F.lower(key)
    hits = keys.agg(*[F.count_if(low.rlike("|".join(words))).alias(r) for r, words in S.CATEGORY_WORDS.items()])
    return hits.select(F.inline(F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).alias("n_hits")) for r in S.CATEGORY_WORDS])))


def coverage_decision(covered: DataFrame, least: int = 3) -> DataFrame:
    """n_covered, enough: how many resources some key stands for, and whether they are enough to map the corpus."""
    return covered.agg(F.count_if(F.col("n_hits") > 0).alias("n_covered")).withColumn("enough", F.col("n_covered") >= least)


def pivot_systems(answers: DataFrame, row: str, system: str, value: str, systems: tuple[str, ...]) -> DataFrame:
    """One row per input with each system's answer beside the other's."""
    return answers.groupBy(row).pivot(system, list(systems)).agg(F.first(value))


def training_steps(n: int, batch: int, accumulate: int, epochs: float, world: int = 1) -> int:
    """Optimiser steps of a run: at least 1."""
    effective = max(1, batch * accumulate * world)
    return max(1, -(-n // effective) * -int(-epochs // 1))
