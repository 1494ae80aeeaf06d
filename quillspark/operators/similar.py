"""Similar terms: a self-join of a vocabulary by token-sort ratio, by segments in place of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fuzzy import token_sort_ratio_udf


def similar_terms(terms: DataFrame, term: str, least: float) -> DataFrame:
    """a, b, similarity of each two different terms, a < b, whose token-sort ratio is at least `least` (above 200/3).

    Two strings of lengths m <= n with that ratio are D = (1 - least/100) (m + n) insertions and
    deletions apart at most, which is at most k = m (200 - 2 least) / least whatever n is. Each
    spoils one segment at most, so of k + 1 segments of the shorter one some segment is in the
    longer one too, moved by D at most. Pairs meet by such a segment and are then compared.
    """
    if 3 * least <= 200:
        raise ValueError("terms can be joined by segments for a ratio above 200/3 only")
    share, eps = least / 100, 1e-9
    each = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("t")).distinct()
    each = each.select("t", F.array_join(F.array_sort(F.filter(F.split("t", r"\s+"), lambda w: w != "")), " ").alias("s")).withColumn("n", F.length("s"))

    def k(m: Column) -> Column:
        return F.floor(m * ((200 - 2 * least) / least) + eps).cast("int")

    def start(m: Column, i: Column) -> Column:
        return F.floor(i * m / (k(m) + 1)).cast("int")

    def piece(m: Column, i: Column, at: Column) -> Column:
        return F.struct(m.alias("m"), i.alias("i"), F.substr(F.col("s"), at + 1, start(m, i + 1) - start(m, i)).alias("piece"))

    def probes(m: Column) -> Column:
        far = F.floor((1 - share) * (m + F.col("n")) + eps).cast("int")
        size = lambda i: start(m, i + 1) - start(m, i)
        places = lambda i: F.sequence(F.greatest(F.lit(0), start(m, i) - far), F.least(F.col("n") - size(i), start(m, i) + far))
        return F.flatten(F.transform(F.sequence(F.lit(0), k(m)), lambda i: F.transform(places(i), lambda at: piece(m, i, at))))

    own = each.select(F.col("t").alias("x"), F.inline(F.transform(F.sequence(F.lit(0), k(F.col("n"))), lambda i: piece(F.col("n"), i, start(F.col("n"), i)))))
    shortest = F.ceil(F.col("n") * (share / (2 - share)) - eps).cast("int")
    sought = each.select(F.col("t").alias("y"), F.inline(F.flatten(F.transform(F.sequence(shortest, F.col("n")), probes))))
    pairs = own.join(sought.distinct(), ["m", "i", "piece"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("similarity", token_sort_ratio_udf("a", "b")).where(F.col("similarity") >= least)
