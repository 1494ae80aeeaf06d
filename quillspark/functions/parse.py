"""Tolerant parsing of model output into records, in the JVM.

A candidate counts only if it is a JSON object whose parts have the right types: the text is
parsed to a VARIANT, whose types can be asked for, since plain from_json coerces numbers to
strings and takes text that isn't JSON. Missing lists are empty; a null list, a missing
required field, a wrong type or an unknown code fails the candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.text import strip_fence, strip_reasoning


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _field(v: Column, name: str, kinds: str, required: bool, allowed: tuple[str, ...] = (), nullable: bool = True) -> Column:
    kind = _kind(v, f"$.{name}")
    fits = kind.rlike(f"^({kinds})")
    if allowed:
        fits = fits & F.try_variant_get(v, f"$.{name}", "string").isin(*allowed)
    missing = kind.isNull() if not nullable else kind.isNull() | (kind == "VOID")
    return F.coalesce(fits, F.lit(False)) if required else F.coalesce(fits, F.lit(False)) | F.coalesce(missing, F.lit(True))


_NUMBER = "BIGINT|DECIMAL|DOUBLE"


def _rules() -> dict[str, list]:
    text = "STRING"
    dosage = lambda v: F.coalesce(_kind(v, "$.dosage").rlike("^OBJECT"), F.lit(False)) & _field(v, "dosage.dose", _NUMBER, False) & _field(v, "dosage.unit", text, False) & _field(v, "dosage.route", text, False) & _field(v, "dosage.frequency", text, False) | _kind(v, "$.dosage").isNull()
    lists = lambda v: F.coalesce(_kind(v, "$.manifestation").rlike(r"^ARRAY<(STRING|VOID)>"), _kind(v, "$.manifestation").isNull())
    return {
        "conditions": [lambda v: _field(v, "code_text", text, True), lambda v: _field(v, "clinical_status", text, True, S.CLINICAL_STATUSES), lambda v: _field(v, "onset_date", text, False)],
        "medications": [lambda v: _field(v, "medication_text", text, True), dosage, lambda v: _field(v, "status", text, False, S.MEDICATION_STATUSES, False)],
        "allergies": [lambda v: _field(v, "substance_text", text, True), lists, lambda v: _field(v, "criticality", text, False, S.CRITICALITIES)],
        "vitals": [lambda v: _field(v, "loinc_code", text, True, tuple(S.DISPLAYS)), lambda v: _field(v, "value", _NUMBER, True), lambda v: _field(v, "unit", text, True)],
        "procedures": [lambda v: _field(v, "code_text", text, True), lambda v: _field(v, "performed_date", text, False), lambda v: _field(v, "status", text, False, S.PROCEDURE_STATUSES, False)],
    }


def _list_valid(v: Column, name: str, rules: list) -> Column:
    kind = _kind(v, f"$.{name}")
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")

    def good(x):
        out = F.coalesce(F.schema_of_variant(x).rlike("^OBJECT"), F.lit(False))
        for rule in rules:
            out = out & rule(x)
        return out

    return kind.isNull() | F.coalesce(kind.rlike("^ARRAY") & F.forall(items, good), F.lit(False))


def _valid(v: Column) -> Column:
    out = F.coalesce(F.schema_of_variant(v).rlike("^OBJECT"), F.lit(False))
    for name, rules in _rules().items():
        out = out & _list_valid(v, name, rules)
    return out


def is_record(text: Column) -> Column:
    """Whether a text is a valid record."""
    return F.get(F.transform(F.array(F.try_parse_json(text)), _valid), F.lit(0))


def valid_text(text: Column) -> Column:
    """The first valid of the raw text, and it without its fence, its reasoning, and both; null if none is. Each different one is parsed once."""
    tries = F.array_distinct(F.array(text, strip_fence(text), strip_reasoning(text), strip_fence(strip_reasoning(text))))
    read = F.transform(tries, lambda t: F.struct(t.alias("text"), F.try_parse_json(t).alias("v")))
    return F.get(F.filter(read, lambda x: _valid(x["v"])), F.lit(0))["text"]


def _record(good: Column) -> Column:
    return with_defaults(F.from_json(F.coalesce(good, F.lit("{}")), S.RECORD))


def parse_record(text: Column) -> Column:
    """struct(record, parsed): the record that valid_text finds, an empty one if there is none."""
    good = valid_text(text)
    return F.struct(_record(good).alias("record"), good.isNotNull().alias("parsed"))


def parsed_records(rows: DataFrame, text: str) -> DataFrame:
    """rows with record and parsed, as parse_record gives them. The steps are generators, so that no later column repeats them."""
    found = rows.select("*", F.explode(F.array(valid_text(F.col(text)))).alias("_good"))
    found = found.select("*", F.explode(F.array(_record(F.col("_good")))).alias("record"))
    return found.withColumn("parsed", F.col("_good").isNotNull()).drop("_good")


def with_defaults(r: Column) -> Column:
    """A record with empty lists, statuses and displays filled in."""
    empty = {f.name: F.array().cast(f.dataType) for f in S.RECORD.fields}
    displays = F.create_map(*[F.lit(x) for kv in S.DISPLAYS.items() for x in kv])
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("dose", "double"), ("unit", "string"), ("route", "string"), ("frequency", "string"))])
    lists = {
        "conditions": r["conditions"],
        "medications": F.transform(r["medications"], lambda m: F.struct(m["medication_text"].alias("medication_text"), F.coalesce(m["dosage"], none).alias("dosage"), F.coalesce(m["status"], F.lit("active")).alias("status"))),
        "allergies": F.transform(r["allergies"], lambda a: F.struct(a["substance_text"].alias("substance_text"), F.coalesce(a["manifestation"], F.array().cast("array<string>")).alias("manifestation"), a["criticality"].alias("criticality"))),
        "vitals": F.transform(r["vitals"], lambda v: F.struct(v["loinc_code"].alias("loinc_code"), displays[v["loinc_code"]].alias("display"), v["value"].alias("value"), v["unit"].alias("unit"))),
        "procedures": F.transform(r["procedures"], lambda p: F.struct(p["code_text"].alias("code_text"), p["performed_date"].alias("performed_date"), F.coalesce(p["status"], F.lit("completed")).alias("status"))),
    }
    return F.struct(*[F.coalesce(v, empty[k]).alias(k) for k, v in lists.items()])
