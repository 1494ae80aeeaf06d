"""Deterministic sampling: which facts a note tells, by hashes of seed, encounter and purpose.

The order and the rate of each draw depend on the encounter alone, so partitions and reruns
don't matter. `exact_seed` gives the 64-bit seed of a per-encounter random stream instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_narratable
from quillspark.operators.splits import fraction, seeded

# Fractions kept of each resource, the chance that an allergy is told, and what is kept whole.
RATES = {"conditions": (0.4, 0.8), "medications": (0.5, 1.0), "procedures": (0.5, 1.0)}
ALLERGY_RATE, SMALL = 0.7, 3


def exact_seed(seed: int, key: Column) -> Column:
    """The first 16 hex digits of sha256("seed:key") as a number: beyond 63 bits, so a decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def pick(seed: int, key: Column, purpose: str, choices: tuple[str, ...]) -> Column:
    """One of the choices, by hash."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(fraction(seeded(seed, key, purpose)) * len(choices)) + 1).cast("int"))


def sampled(facts: DataFrame, encounter: str, resource: str, pos: str, text: str, seed: int) -> DataFrame:
    """facts that are told: narratable ones; of more than SMALL of a resource, a drawn fraction; allergies by chance; all vitals.

    If nothing would be left of an encounter, its first narratable allergy stays.
    """
    key, res = F.col(encounter), F.col(resource)
    able = facts.where((res == "vitals") | is_narratable(F.col(text), res))
    group = Window.partitionBy(encounter, resource)
    n = F.count(F.lit(1)).over(group)
    u = fraction(seeded(seed, F.concat(key.cast("string"), F.lit(":"), res), "rate"))
    low = F.create_map(*[x for r, (a, _) in RATES.items() for x in (F.lit(r), F.lit(a))])[res]
    span = F.create_map(*[x for r, (a, b) in RATES.items() for x in (F.lit(r), F.lit(round(b - a, 10)))])[res]
    quota = F.when(n <= SMALL, n).otherwise(F.greatest(F.lit(1), F.bround(n * (low + span * u), 0).cast("long")))
    draw = seeded(seed, F.concat(key.cast("string"), F.lit(":"), res, F.lit(":"), F.col(pos).cast("string")), "draw")
    ranked = able.withColumn("_draw", draw).withColumn("_rank", F.row_number().over(group.orderBy("_draw", text))).withColumn("_quota", quota)
    told = F.when(res == "vitals", F.lit(True)).when(res == "allergies", fraction(F.col("_draw")) < ALLERGY_RATE).otherwise(F.col("_rank") <= F.col("_quota"))
    ranked = ranked.withColumn("_told", told)
    whole = Window.partitionBy(encounter)
    saved = (F.col(resource) == "allergies") & ~F.max("_told").over(whole) & (F.col(pos) == F.min(pos).over(whole))
    return ranked.withColumn("_saved", saved).where("_told or _saved").drop("_draw", "_rank", "_quota", "_told", "_saved")
