import json

import pytest
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark.operators import bundles, external, faithful, passes, prompts, report, scoring, splits, stats
from quillspark.plans import catalog
from quillspark.sources import completer, files
from quillspark.streaming import resume

ENTRIES = [
    {"resourceType": "Patient", "id": "p1", "birthDate": "1980-06-01", "gender": "female"},
    {"resourceType": "Encounter", "id": "e2", "period": {"start": "2020-03-04T10:00:00Z"}},
    {"resourceType": "Encounter", "id": "e1"},
    {"resourceType": "Encounter", "id": "e3"},
    {"resourceType": "Condition", "encounter": {"reference": "urn:uuid:e2"}, "code": {"text": "Cough"}, "clinicalStatus": {"coding": [{"code": "active"}, {"code": "resolved"}]}, "onsetDateTime": "2019-01-02T00:00:00"},
    {"resourceType": "Condition", "encounter": {"reference": "Encounter/e2"}, "code": {"text": "Cold"}, "clinicalStatus": {"coding": [{"code": "odd"}]}},
    {"resourceType": "Condition", "encounter": {"reference": "Encounter/zz"}, "code": {"text": "Lost"}},
    {"resourceType": "Condition", "encounter": {"reference": "Encounter/e2"}, "code": {}},
    {"resourceType": "MedicationStatement", "encounter": {"reference": "Encounter/e2"}, "medicationCodeableConcept": {"text": "B"}},
    {"resourceType": "MedicationRequest", "encounter": {"reference": "Encounter/e2"}, "medicationCodeableConcept": {"text": "A"}},
    {"resourceType": "AllergyIntolerance", "code": {"text": "Nuts"}, "criticality": "high", "reaction": [{"manifestation": [{"text": "rash"}]}, {"manifestation": [{}]}, {}]},
    {"resourceType": "Observation", "encounter": {"reference": "Encounter/e2"}, "code": {"coding": [{"code": "x"}, {"code": "8867-4"}, {"code": "8310-5"}]}, "valueQuantity": {"value": 72, "unit": "/min"}},
    {"resourceType": "Observation", "encounter": {"reference": "Encounter/e2"}, "code": {"coding": [{"code": "85354-9"}]}, "component": [{"code": {"coding": [{"code": "8480-6"}]}, "valueQuantity": {"value": 132, "unit": "mmHg"}}, {"code": {"coding": [{"code": "8462-4"}]}}, {"code": {"coding": [{"code": "8462-4"}]}, "valueQuantity": {"value": 84}}]},
    {"resourceType": "Procedure", "encounter": {"reference": "Encounter/e2"}, "code": {"text": "Xray"}, "performedPeriod": {"start": "2020-03-04T11:00"}, "performedDateTime": "2000-01-01"},
    {"resourceType": "Immunization", "encounter": {"reference": "Encounter/e2"}},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("bundles")
    (at / "b.json").write_text(json.dumps({"entry": [{"resource": r} for r in ENTRIES]}, indent=1))
    (at / "nobody.json").write_text(json.dumps({"entry": [{"resource": r} for r in ENTRIES[1:]]}))
    (at / "hospitalInformation1.json").write_text("{}")
    return str(at)


def test_bundles(spark, folder):
    got = {r.encounter_id: r for r in bundles.encounters(files.bundles(spark, folder)).collect()}
    assert sorted(got) == ["e1", "e2"]
    r = got["e2"]
    assert (r.patient_id, r.encounter_date, r.age, r.sex) == ("p1", "2020-03-04", 40, "female")
    assert [(c.code_text, c.clinical_status, c.onset_date) for c in r.record.conditions] == [("Cough", "resolved", "2019-01-02"), ("Cold", "active", None)]
    assert [m.medication_text for m in r.record.medications] == ["A", "B"]
    assert [(v.loinc_code, v.value, v.unit) for v in r.record.vitals] == [("8867-4", 72.0, "/min"), ("8480-6", 132.0, "mmHg"), ("8462-4", 84.0, "")]
    assert r.record.procedures[0].performed_date == "2020-03-04" and r.record.allergies == []
    (a,) = got["e1"].record.allergies
    assert (a.substance_text, a.manifestation, a.criticality) == ("Nuts", ["rash", ""], "high")
    assert (got["e1"].encounter_date, got["e1"].age) == ("1970-01-01", 0)


def test_large_bundle(spark, tmp_path):
    """No row but the bundle's own holds it: with the whole beside each of 8,001 resources, this would take 16 GB."""
    n = 4000
    visits = [r for i in range(n) for r in ({"resourceType": "Encounter", "id": f"e{i}"}, {"resourceType": "Condition", "encounter": {"reference": f"Encounter/e{i}"}, "code": {"text": f"c{i}"}})]
    entries = [*visits, {"resourceType": "AllergyIntolerance", "code": {"text": "Nuts"}}, {"resourceType": "Patient", "id": "p1", "gender": "male"}]
    (tmp_path / "b.json").write_text(json.dumps({"entry": [{"resource": r} for r in entries]}))
    made = bundles.encounters(files.bundles(spark, str(tmp_path)))
    got = {r.encounter_id: r for r in made.collect()}
    assert sorted(got) == sorted(f"e{i}" for i in range(n))
    assert all(r.patient_id == "p1" and r.sex == "male" and [c.code_text for c in r.record.conditions] == [f"c{k[1:]}"] for k, r in got.items())
    assert [k for k, r in got.items() if r.record.allergies] == ["e0"]


def test_bundle_files_are_written_line_by_line(spark, tmp_path, monkeypatch):
    """A file for each nation, valid as a whole, of which no line holds more than a visit and what it says."""
    spark.createDataFrame([(0,), (1,), (2,)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    rows = [(k, k % 2, 'A "quoted"\nline') for k in range(1000, 0, -1)] + [(1001, 7, "no nation")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").repartition(5).write.parquet(str(tmp_path / "customer.parquet"))
    at = tmp_path / "at"
    monkeypatch.setattr(files, "scratch", lambda spark: str(at))
    got = catalog.QUERIES["bundle_files"](spark, str(tmp_path)).collect()
    assert sorted((int(r.encounter_id), r.patient_id, r.condition) for r in got) == sorted((k, str(n), s) for k, n, s in rows[:-1])
    for n in range(3):
        (one,) = (at / f"folder={n}").glob("*.json")
        assert max(map(len, one.read_text().splitlines())) < 300
        entry = [e["resource"] for e in json.loads(one.read_text())["entry"]]
        keys = [str(k) for k in range(1, 1001) if k % 2 == n]
        assert entry[0] == {"resourceType": "Patient", "id": str(n)}
        assert [e["id"] for e in entry[1::2]] == keys and [e["encounter"]["reference"] for e in entry[2::2]] == [f"Encounter/{k}" for k in keys]


def test_stream_makes_each_encounter_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    make = lambda df: bundles.encounters(df).select("encounter_id", F.lit("n").alias("note"))
    for _ in range(2):
        resume.generate(spark, folder, out, str(tmp_path / "ck"), make).awaitTermination()
    assert sorted(r.encounter_id for r in spark.read.json(out).collect()) == ["e1", "e2"]
    assert files.done_ids(spark, str(tmp_path / "none")).count() == 0


def test_fhir_and_validity(spark, folder):
    rows = bundles.encounters(files.bundles(spark, folder)).where("encounter_id = 'e2'")
    out = [json.loads(x) for x in rows.select(bundles.fhir_resources(F.col("record"))).first()[0]]
    assert [x["resourceType"] for x in out] == ["Condition"] * 2 + ["MedicationStatement"] * 2 + ["Observation"] * 3 + ["Procedure"]
    assert "onsetDateTime" not in out[1] and out[4]["valueQuantity"] == {"value": 72.0, "unit": "/min"}
    assert rows.select(bundles.fhir_errors(F.col("record"))).first()[0] == ["Observation: 8462-4"]  # no unit


def test_external_corpus(spark, tmp_path):
    rows = [{"patient_uid": "7-1", "report": "r", "summary": {"diagnosis": "a; b", "comorbidities": "N/A", "pharmacological_therapy": "x", "medical_surgical_history": "z"}}, {"patient_id": 5, "report": "r", "summary": {"diagnosis": "n/a"}}, {"report": "r", "summary": {"interventional_therapy": "op"}}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    fields = {f for fs in S.EXTERNAL_FIELDS.values() for f in fs}
    schema = __import__("pyspark.sql.types", fromlist=["x"])._parse_datatype_string("patient_uid string, patient_id long, report string, summary struct<" + ",".join(f"{f}:string" for f in sorted(fields)) + ">")
    got = external.pairs(files.json_array(spark, str(tmp_path / "c.json"), schema)).collect()
    assert [r.patient_id for r in got] == ["7-1", "None"]
    assert [c.code_text for c in got[0].label.conditions] == ["a", "b"] and got[1].label.procedures[0].status == "completed"
    assert external.pairs(files.json_array(spark, str(tmp_path / "c.json"), schema, 2)).count() == 1


def test_json_keys_of_anything(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.json").write_text('{"x": 1, "y": 2}')
    (tmp_path / "d" / "b.json").write_text('[{"x": 1}, 3, {"z": 1}]')
    (tmp_path / "bad.json").write_text("nope")
    assert [tuple(r) for r in stats.key_counts(files.json_objects(spark, str(tmp_path)), "body").collect()] == [("x", 2), ("y", 1), ("z", 1)]


def test_splits_keep_patients_together_and_meet_targets(spark):
    df = spark.createDataFrame([(f"p{i}", j) for i in range(40) for j in range(1 + i % 4)], "patient_id string, j int")
    got = splits.split_by_entity(df, "patient_id", {"train": 5, "val": 10, "test": 12, "none": 0}, 42)
    by = {}
    for r in got.collect():
        by.setdefault(r.patient_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert 10 <= n["val"] < 14 and 12 <= n["test"] < 16 and sum(n.values()) == df.count() and "none" not in n
    tiny = splits.split_by_entity(df.limit(3), "patient_id", {"val": 100}, 1)
    assert {r.split for r in tiny.collect()} == {"val"}
    held = splits.reserve_slice(df, "patient_id", F.col("j") == 2, 5, 42)
    assert held.where("held and j = 2").count() == 5 and splits.reserve_slice(df, "patient_id", F.lit(True), 0, 1).where("held").count() == 0


def test_passes(spark):
    with pytest.raises(ValueError):
        passes.matches("odd")
    df = spark.createDataFrame([(f"e{i}", i) for i in range(6)], "encounter_id string, pos int")
    done = df.where("pos < 2")
    assert [r.pos for r in passes.work_list(df, done, 4, "pos").collect()] == [2, 3]
    assert [r.pos for r in passes.work_list(df, done, 1, "pos").collect()] == [2]


def test_completer_keeps_order_and_survives_failures(spark):
    def sometimes(prompts):
        if "bad" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "c")], "i int, prompt string").coalesce(1)
    assert [(r.i, r.completion) for r in completer.complete(df, sometimes).orderBy("i").collect()] == [(0, "A"), (1, ""), (2, "C")]
    with pytest.raises(ValueError):
        completer.build("none")


def test_faithfulness(spark):
    notes = spark.createDataFrame([(1, "Pt with HTN and anaemia, BP 120/80, on aspirin and metformin."), (2, "Nothing. BP: 150/95")], "row_id int, note string")
    facts = spark.createDataFrame([(1, "conditions", 0, "Hypertension (disorder)", None), (1, "conditions", 1, "Anemia", None), (1, "medications", 0, "Metformin 500 MG", None), (1, "vitals", 0, "Systolic blood pressure", 120.0), (2, "conditions", 0, "Gout", None), (2, "conditions", 1, " ", None)], "row_id int, resource string, pos int, text string, value double")
    got = {r.row_id: r for r in faithful.checked(notes, facts, "row_id").collect()}
    assert got[1].missing == ["Medication: Metformin 500 MG"] and got[1].invented == ["Medication (invented): aspirin"]
    assert got[2].missing == ["Condition: Gout", "Condition:  "] and got[2].invented == ["Vital (invented): BP 150/95"] and not got[2].clean


def test_scoring(spark):
    with pytest.raises(ValueError):
        scoring.check_resources("conditions,odd")
    assert scoring.check_resources(" ") == S.RESOURCES
    rows = spark.createDataFrame([(1, 1, 0, True, 0, 0, {"conditions": (1, 1, 0)}), (0, 0, 2, False, 3, 2, {"vitals": (0, 0, 2), "procedures": (0, 0, 0)})], "tp int, fp int, fn int, schema_valid boolean, hallucinated int, omitted int, per_resource map<string,struct<tp:int,fp:int,fn:int>>")
    r = scoring.aggregate(rows).first()
    assert (r.n, r.micro_f1, r.macro_f1, r.schema_validity, r.hallucination_rate, r.omission_rate) == (2, 0.4, 0.3333, 0.5, 1.5, 1.0)
    empty = scoring.aggregate(rows.limit(0)).first()
    assert (empty.n, empty.micro_f1, empty.macro_f1, empty.schema_validity) == (0, 0.0, 0.0, 0.0)


def test_prompts(spark):
    df = spark.createDataFrame([("e1", "2020-01-01", 40, "male", ([("Cold {age}", "active", None)], [("A", (5.0, "mg", None, "daily"), "active"), ("B", (0.0, "mg", None, None), "active")], [], [], []))], S.T._parse_datatype_string(f"encounter_id string, encounter_date string, age int, sex string, record {S.RECORD_DDL}"))
    r = prompts.note_prompts(df, 1).first()
    assert "- Condition: Cold {age}, status active\n- Medication: A (5.0mg, daily)\n- Medication: B" in r.prompt and "40-year-old male" in r.prompt
    assert r.variant.doc_type in S.DOC_TYPES and prompts.note_prompts(df, 1).first() == r
    shown = df.select(prompts.extraction_prompt(F.lit("N"), False, [("n1", "{}")]).alias("a"), prompts.prompt_for(F.lit("tuned"), "tuned", F.lit("N")).alias("b"), prompts.prompt_for(F.lit("x"), "tuned", F.lit("N")).alias("c")).first()
    assert "n1" in shown.a and "schema" not in shown.b and "schema" in shown.c


def test_reports(spark, tmp_path):
    base = (3, 0.5, 0.4, 1.0, 0.1, 0.2, None, "llm", "fhir-v2-100", 0, False, True, ["vitals"], "test")
    df = spark.createDataFrame([base, (*base[:7], "regex", None, *base[9:])], S.RESULT)
    report.write_result(df, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["tag=llm_fhir-v2-100_0shot_test", "tag=regex_0shot_test"]
    shown = report.markdown(df.withColumn("path", F.lit("a")))
    assert shown.splitlines()[2].startswith("| Regex baseline | 0.500") and "step 100" in shown.splitlines()[3]
    assert stats.training_steps(100, 4, 8, 1.5) == 8 and stats.training_steps(0, 1, 1, 1) == 1
