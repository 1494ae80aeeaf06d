"""Faithfulness: which labelled facts a note doesn't support, and which facts it has that no label has.

A row's facts are few, so they are gathered to a list and meet their note once; the note is
normalised once and goes to a function once, however many facts it has. Cheap steps (the term
itself, abbreviations, numbers) are decided in the JVM; only what they leave open goes to the
fuzzy functions. Nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.fuzzy import all_anchored_udf, resemble_udf
from quillspark.functions.text import anchored_plainly, normalise, number_anchored, printf_tenth, strip

_KIND = {"conditions": "Condition", "medications": "Medication", "allergies": "Allergy", "vitals": "Vital", "procedures": "Procedure"}


def _met(notes: DataFrame, facts: DataFrame, row: str, note: str, how: str = "left") -> DataFrame:
    """notes with their normal form, the row's facts with their normal terms (an empty list where there are none), and whether each is anchored."""
    fields = [c for c in facts.columns if c != row]
    lists = facts.select(row, F.struct(*fields, strip(normalise(F.col("text"))).alias("_term")).alias("_fact")).groupBy(row).agg(F.collect_list("_fact").alias("_facts"))
    rows = notes.withColumn("_note", F.col(note)).withColumn("_norm", normalise(F.col(note))).join(lists, row, how)
    rows = rows.withColumn("_facts", F.coalesce("_facts", F.array().cast(lists.schema["_facts"].dataType)))
    vital = lambda f: f["resource"] == "vitals"
    plain = F.transform("_facts", lambda f: F.coalesce(F.when(vital(f), number_anchored(f["value"], F.col("_note"))).otherwise(anchored_plainly(f["_term"], F.col("_norm"))), F.lit(False)))
    rows = rows.withColumn("_plain", plain)
    # what is decided already goes to the function as an empty term, which costs it nothing
    rows = rows.withColumn("_open", F.zip_with("_facts", "_plain", lambda f, p: F.when(p | vital(f), "").otherwise(f["_term"])))
    fuzzy = all_anchored_udf("_open", F.when(F.exists("_open", lambda t: t != ""), F.col("_norm")))
    return rows.withColumn("_anchored", F.zip_with("_plain", fuzzy, lambda p, q: p | q))


def anchors(facts: DataFrame, notes: DataFrame, row: str, note: str = "note") -> DataFrame:
    """facts(row, resource, pos, text, value) with `anchored`: whether the row's note supports each."""
    fields = [c for c in facts.columns if c != row]
    met = _met(notes.select(row, note), facts, row, note, "inner")
    return met.select(row, F.inline(F.zip_with("_facts", "_anchored", lambda f, a: F.struct(*[f[c].alias(c) for c in fields], a.alias("anchored")))))


def _missing() -> Column:
    names = F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])
    order = F.array(*map(F.lit, S.RESOURCES))

    def told(f):
        text = F.when(f["resource"] == "vitals", F.concat_ws("=", f["text"], f["value"].cast("string"))).otherwise(f["text"])
        return F.struct(F.array_position(order, f["resource"]).alias("rank"), f["pos"].alias("pos"), F.concat(names[f["resource"]], F.lit(": "), text).alias("told"))

    lost = F.filter(F.zip_with("_facts", "_anchored", lambda f, a: F.when(~a, told(f))), lambda x: x.isNotNull())
    return F.transform(F.array_sort(lost), lambda x: x["told"])


def unanchored(facts: DataFrame, notes: DataFrame, row: str, note: str = "note") -> DataFrame:
    """row, missing: messages on each row's unsupported facts, by resource and position; an empty list where there are none."""
    return _met(notes.select(row, note), facts, row, note).select(row, _missing().alias("missing"))


def drugs_in(note_norm: Column) -> Column:
    """The known drugs that a normalised note names as whole words, in the dictionary's order."""
    longer = F.filter(F.array(*[F.lit(d) for d in S.DRUGS if " " in d]), lambda d: F.concat(F.lit(" "), note_norm, F.lit(" ")).contains(F.concat(F.lit(" "), d, F.lit(" "))))
    return F.array_intersect(F.array(*map(F.lit, S.DRUGS)), F.concat(F.split(note_norm, " "), longer))


def _invented(met: DataFrame) -> DataFrame:
    """met with `invented`."""
    no_text = F.array().cast("array<string>")
    labels = F.filter(F.transform(F.filter("_facts", lambda f: f["resource"] == "medications"), lambda f: f["_term"]), lambda t: t.isNotNull())
    met = met.withColumn("_labels", labels).withColumn("_drugs", F.coalesce(drugs_in(F.col("_norm")), no_text))
    met = met.withColumn("_drugs", F.filter("_drugs", lambda d: ~F.exists("_labels", lambda t: t.contains(d))))
    like = resemble_udf("_drugs", "_labels")
    drugs = F.filter(F.zip_with("_drugs", like, lambda d, x: F.when(~x, F.concat(F.lit("Medication (invented): "), d))), lambda x: x.isNotNull())
    values = F.transform(F.filter("_facts", lambda f: (f["resource"] == "vitals") & f["value"].isNotNull()), lambda f: printf_tenth(f["value"]).cast("double"))
    met = met.withColumn("_values", values)
    pressures = F.transform(F.regexp_extract_all("_note", F.lit(S.BP_PATTERN), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, S.BP_PATTERN, 1).alias("s"), F.regexp_extract(m, S.BP_PATTERN, 2).alias("d")))
    new = F.filter(pressures, lambda p: ~F.array_contains("_values", p["s"].cast("double")) & ~F.array_contains("_values", p["d"].cast("double")))
    told = F.transform(new, lambda p: F.concat(F.lit("Vital (invented): BP "), p["s"], F.lit("/"), p["d"]))
    return met.withColumn("invented", F.concat(drugs, F.coalesce(told, no_text)))


def invented(notes: DataFrame, facts: DataFrame, row: str, note: str = "note") -> DataFrame:
    """row, invented: drugs that the note names and no labelled medication resembles, then blood pressures no labelled value has."""
    return _invented(_met(notes.select(row, note), facts, row, note)).select(row, "invented")


def checked(notes: DataFrame, facts: DataFrame, row: str, note: str = "note") -> DataFrame:
    """notes with missing, invented, faithful and clean: one join and one pass."""
    out = _invented(_met(notes, facts, row, note)).select(*notes.columns, _missing().alias("missing"), "invented")
    faithful = F.size("missing") == 0
    return out.withColumn("faithful", faithful).withColumn("clean", faithful & (F.size("invented") == 0))
