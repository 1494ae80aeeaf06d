"""The external annotated corpus: semicolon lists of each category to records, ids to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.functions.text import split_entries


def record(summary: Column) -> Column:
    """A record of a summary's lists; categories that mix resources aren't mapped."""
    def entries(resource):
        return F.flatten(F.array(*[split_entries(summary[f]) for f in S.EXTERNAL_FIELDS[resource]]))

    conditions = F.transform(entries("conditions"), lambda t: F.struct(t.alias("code_text"), F.lit("active").alias("clinical_status"), F.lit(None).cast("string").alias("onset_date")))
    dosage = F.struct(F.lit(None).cast("double").alias("dose"), *[F.lit(None).cast("string").alias(n) for n in ("unit", "route", "frequency")])
    medications = F.transform(entries("medications"), lambda t: F.struct(t.alias("medication_text"), dosage.alias("dosage"), F.lit("active").alias("status")))
    procedures = F.transform(entries("procedures"), lambda t: F.struct(t.alias("code_text"), F.lit(None).cast("string").alias("performed_date"), F.lit("completed").alias("status")))
    none = {f.name: F.array().cast(f.dataType) for f in S.RECORD.fields}
    return F.struct(conditions.alias("conditions"), medications.alias("medications"), none["allergies"].alias("allergies"), none["vitals"].alias("vitals"), procedures.alias("procedures"))


def pairs(rows: DataFrame) -> DataFrame:
    """(patient_uid, patient_id, report, summary) -> patient_id, encounter_id, note, label; rows without any label fact are left out."""
    patient = F.coalesce(F.nullif(F.nullif(F.col("patient_uid").cast("string"), F.lit("")), F.lit("0")), F.col("patient_id").cast("string"), F.lit("None"))
    out = rows.select(patient.alias("patient_id"), patient.alias("encounter_id"), F.col("report").alias("note"), record(F.col("summary")).alias("label"))
    return out.where(" + ".join(f"size(label.{r})" for r in S.EXTERNAL_FIELDS) + " > 0")
