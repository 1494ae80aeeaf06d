"""Prompts and chat examples as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.operators.sampling import pick
from quillspark.sources.files import exists

NOTE_PROMPT = """Write the clinical note of an encounter on {date} with a {age}-year-old {sex} patient.

State all of these facts:
{facts}

Add no other diagnosis, drug, allergy, measurement or procedure. Write as clinicians do, without
field names and without the tags in brackets after a term. Form: {doc_type}, {style}, {noise}.
Give the note and nothing else.

Note:"""
EXTRACT_PROMPT = """Extract the clinical facts that the note states, as one JSON object with the keys
conditions, medications, allergies, vitals and procedures.
{schema}
Note:
{note}

JSON:"""
NO_FACTS = "- (no specific findings; routine visit)"


def fill(template: str, **values: Column) -> Column:
    """A template's named fields, filled in one pass: values that look like fields stay as they are."""
    parts, rest = [], template
    while True:
        at = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not at:
            return F.concat(*parts, F.lit(rest))
        i, k = min(at)
        parts += [F.lit(rest[:i]), F.coalesce(values[k].cast("string"), F.lit(""))]
        rest = rest[i + len(k) + 2 :]


def fact_lines(record: Column) -> Column:
    """A record as bullet lines: conditions, medications, allergies, vital signs, procedures."""
    bracket = lambda c: F.when(F.length(c) > 0, F.concat(F.lit(" ("), c, F.lit(")"))).otherwise("")
    dose = lambda d: F.when((d["dose"] != 0) & (F.length(d["unit"]) > 0), F.concat(d["dose"].cast("string"), d["unit"]))
    some = lambda c: F.when(F.length(c) > 0, c)
    lines = [
        F.transform(record["conditions"], lambda c: F.concat(F.lit("- Condition: "), c["code_text"], F.lit(", status "), c["clinical_status"], F.when(F.length(c["onset_date"]) > 0, F.concat(F.lit(" (onset "), c["onset_date"], F.lit(")"))).otherwise(""))),
        F.transform(record["medications"], lambda m: F.concat(F.lit("- Medication: "), m["medication_text"], bracket(F.concat_ws(", ", dose(m["dosage"]), some(m["dosage"]["route"]), some(m["dosage"]["frequency"]))))),
        F.transform(record["allergies"], lambda a: F.concat(F.lit("- Allergy: "), a["substance_text"], F.when(F.size(a["manifestation"]) > 0, F.concat(F.lit(", reaction: "), F.array_join(a["manifestation"], ", "))).otherwise(""))),
        F.transform(record["vitals"], lambda v: F.concat(F.lit("- Vital sign: "), v["display"], F.lit(" = "), v["value"].cast("string"), F.lit(" "), v["unit"])),
        F.transform(record["procedures"], lambda p: F.concat(F.lit("- Procedure: "), p["code_text"], F.when(F.length(p["performed_date"]) > 0, F.concat(F.lit(" on "), p["performed_date"])).otherwise(""))),
    ]
    all_lines = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lines]))
    return F.when(F.size(all_lines) > 0, F.array_join(all_lines, "\n")).otherwise(NO_FACTS)


def note_prompts(encounters: DataFrame, seed: int, record: str = "record", template: str = NOTE_PROMPT) -> DataFrame:
    """encounters with `variant` (doc_type, style, noise) and `prompt`."""
    key = F.col("encounter_id")
    variant = F.struct(pick(seed, key, "doc_type", S.DOC_TYPES).alias("doc_type"), pick(seed, key, "style", S.STYLES).alias("style"), pick(seed, key, "noise", S.NOISE).alias("noise"))
    out = encounters.withColumn("variant", variant)
    values = {"date": F.col("encounter_date"), "age": F.col("age"), "sex": F.col("sex"), "facts": fact_lines(F.col(record))}
    return out.withColumn("prompt", fill(template, **values, **{k: F.col(f"variant.{k}") for k in ("doc_type", "style", "noise")}))


def exemplars(spark: SparkSession, path: str, shots: int) -> list[tuple[str, str]]:
    """(note, label JSON) of the first `shots` rows of a pair file, for extraction_prompt; none are asked for, none are read."""
    if shots <= 0:
        return []
    if not exists(spark, path):
        raise FileNotFoundError(f"{shots} exemplars were asked for, but there is no {path}; without exemplars it isn't needed")
    lines = spark.read.text(path, wholetext=False).limit(shots).collect()
    found = [json.loads(r["value"]) for r in lines]
    return [(x["note"], json.dumps(x["label"])) for x in found]


def extraction_prompt(note: Column, with_schema: bool | Column = True, exemplars: list[tuple[str, str]] = (), template: str = EXTRACT_PROMPT) -> Column:
    """The extraction prompt: exemplars (note, label JSON) first, the schema if asked for."""
    rule = F.lit(f"The JSON must validate against this schema:\n{S.RECORD_DDL}\n")
    schema = F.when(with_schema, rule).otherwise("") if isinstance(with_schema, Column) else (rule if with_schema else F.lit(""))
    shots = [F.concat(fill(template, schema=schema, note=F.lit(n)), F.lit(f" {label}\n\n")) for n, label in exemplars]
    return F.concat(*shots, fill(template, schema=schema, note=note))


def prompt_for(model: Column, tuned: str, note: Column) -> Column:
    """A tuned model gets the bare prompt, any other the schema too."""
    return extraction_prompt(note, model != tuned)


def chat(prompt: Column, answer: Column) -> Column:
    """A training example: the prompt without trailing white space, and the answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", F.regexp_replace(prompt, r"\s+$", "")), turn("assistant", answer))


def conversations(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conversation, messages: turns in order as (role, content)."""
    one = F.struct(F.col(turn).alias("turn"), F.struct(F.col(role).alias("role"), F.col(text).alias("content")).alias("message"))
    return turns.groupBy(conversation).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["message"]).alias("messages"))
