import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fuzzy, parse, text


def column(spark, values, f, *more):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f(*[F.col(f"c{i}") for i in range(len(rows[0]))]).alias("x")).collect()]


def test_normalise(spark):
    got = column(spark, ["Chronic sinusitis (disorder)", "Knee (left) pain", "A-fib  HTN!", "x (Finding) ", "líne\ntwo (finding)", None], text.normalise)
    assert got == ["chronic sinusitis", "knee  left  pain", "a fib  htn ", "x", "l ne two  finding ", None]


@pytest.mark.parametrize(("a", "b", "want"), [("type 1 diabetes", "type 2 diabetes", True), ("left knee", "right knee", True), ("hyperglycemia", "hypoglycemia", True), ("chronic pain", "acute pain", True), ("secondary x", "primary x", True), ("stage 3 of 4", "stage 4 of 3", False), ("left knee", "knee left", False), ("", "", False)])
def test_conflicts_in_both_forms(spark, a, b, want):
    assert fuzzy.conflict(a, b) == want and column(spark, [(a, b)], text.discriminators_conflict) == [want]


def test_narratable(spark):
    rows = [("Screening for abuse", "procedures", False), ("Screening", "conditions", True), ("Stress (finding)", "conditions", False), ("Stress (disorder)", "conditions", True), ("Full-time employment (finding)", "conditions", False), ("Dead (situation)", "medications", False), (" ", "allergies", False), ("Unknown", "conditions", False), (None, "conditions", False), ("Obesity (finding)", "conditions", True)]
    got = column(spark, [(a, b) for a, b, _ in rows], text.is_narratable)
    assert got == [w for *_, w in rows]


def test_lists_fences_and_reasoning(spark):
    assert column(spark, [" a ; ;b;", "N/A", None, "none", "x; N/A"], text.split_entries) == [["a", "b"], [], [], [], ["x", "N/A"]]
    assert column(spark, ["```json\n{}\n```", "```\nx\n``` ", "a ```b```", None], text.strip_fence) == ["{}", "x", "a ```b```", None]
    assert column(spark, ["<think>a\nb</think>\n{}", "<think></think><think>x</think> y", "y <think>z</think>"], text.strip_reasoning) == ["{}", "y", "y <think>z</think>"]


def test_vital_signs(spark):
    (got,) = column(spark, ["BP: 120/80, HR 72. temp 98.6 SpO2: 97 wt 70.5 bp 90 / 60"], text.vitals_in)
    assert [(v.loinc_code, v.value, v.unit) for v in got] == [("8480-6", 120, "mmHg"), ("8462-4", 80, "mmHg"), ("8480-6", 90, "mmHg"), ("8462-4", 60, "mmHg"), ("8867-4", 72, "/min"), ("8310-5", 98.6, "F"), ("2708-6", 97, "%"), ("29463-7", 70.5, "kg")]


def test_numbers_round_half_to_even(spark):
    df = spark.createDataFrame([(98.5, "98 F", True), (98.5, "99 F", False), (0.25, "0.2", True), (0.25, "0.3", True), (99.5, "99 F", False), (99.5, "100 F", True), (37.0, "37.0", True), (120.0, "1120", False)], "v double, n string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.number_anchored(F.col("v"), F.col("n")), "want").collect())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity_against_a_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
    known = [("type 1 diabetes", "type 2 diabetes", 93.3), ("hyperglycemia", "hypoglycemia", 88.0), ("hyperglycemia", "hyperthyroidism", None)]
    assert [round(fuzzy.token_sort_ratio(a, b), 1) for a, b, w in known if w] == [w for *_, w in known if w]


def test_partial_alignment_is_the_best_window():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (8, 30))
        s, t = sorted((a, b), key=len)
        n = len(s)
        windows = [t[i : i + n] for i in range(len(t) - n + 1)] + [t[:k] for k in range(1, n)] + [t[-k:] for k in range(1, n)]
        want = max(200.0 * lcs(s, w) / (n + len(w)) for w in windows)
        assert fuzzy.partial_alignment(a, b)[0] == pytest.approx(want)


@pytest.mark.parametrize(("term", "note", "want"), [("anemia", "history of anaemia today", True), ("type 2 diabetes", "has type 1 diabetes", False), ("left knee replacement", "after right knee replacement", False), ("hyperglycemia", "found hypoglycemia", False), ("acute bronchitis", "acute viral pharyngitis", False), ("insulin glargine", "insulin lispro", False)])
def test_fuzzy_anchors(term, note, want):
    assert fuzzy.fuzzily_anchored(term, note) == want


def test_matching_is_greedy_one_to_one():
    m = fuzzy.match_counts
    assert m(["a", "a"], ["a"], False) == (1, 1, 0)
    assert m(["type 2 diabetes"], ["type 1 diabetes"], True) == (0, 1, 1)
    assert m(["essential hypertension", "hypertension"], ["hypertension essential", "hypertension"], True) == (2, 0, 0)
    assert m([], ["x"], True) == (0, 0, 1) and m(["x"], [], True) == (0, 1, 0)


def test_parse_record(spark):
    good = '{"conditions":[{"code_text":"x","clinical_status":"active"}],"extra":1}'
    cases = [(good, True), (f"```json\n{good}\n```", True), (f"<think>a</think>{good}", True), (f"<think>a</think>\n```\n{good}\n```", True), ("nope", False), ("[]", False), ('{"conditions":null}', False), ('{"conditions":[{"code_text":"x"}]}', False), ('{"conditions":[{"code_text":5,"clinical_status":"active"}]}', False), ('{"conditions":[{"code_text":"x","clinical_status":"bad"}]}', False), ('{"vitals":[{"loinc_code":"8867-4","value":72,"unit":"/min","display":"zz"}]}', True), ('{"vitals":[{"loinc_code":"1-1","value":72,"unit":"/min"}]}', False), ("{}", True), (None, False)]
    got = column(spark, [c for c, _ in cases], lambda c: parse.parse_record(c))
    assert [r.parsed for r in got] == [w for _, w in cases]
    assert got[0].record.conditions[0].code_text == "x" and got[4].record.conditions == [] and got[10].record.vitals[0].display == "Heart rate"
