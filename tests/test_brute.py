"""Operators that SQL can't express, against plain Python on the smallest tables or small fixtures."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark import schemas as S
from quillspark import settings
from quillspark.functions import fuzzy, text
from quillspark.operators import passes, prompts, report, similar
from quillspark.plans import catalog
from quillspark.sources import completer

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plain(t):
    m = re.match(r"^(.*)\s*\(([a-z/ ]+)\)\s*$", (t or "").strip(), re.I | re.S)
    t = m[1].strip() if m and m[2].strip().lower() in S.SEMANTIC_TAGS else t or ""
    return re.sub("[^a-z0-9 ]+", " ", t.lower())


def best_window(a, b):
    """Every window compared."""
    s, t = sorted((a, b), key=len)
    n, best = len(s), (-1.0, 0, 0)
    for lo, hi in [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(len(t) - n + 1)] + [(i, len(t)) for i in range(len(t) - n + 1, len(t))]:
        r = 200.0 * fuzzy.common(s, t[lo:hi]) / (n + hi - lo)
        if r > best[0]:
            best = r, lo, hi
    return best if t is b else (best[0], 0, len(b))


def anchored(term, note):
    term, note = plain(term).strip(), plain(note)
    if not term or term in note:
        return bool(term)
    if any(long in term and re.search(rf"\b(?:{'|'.join(map(re.escape, short))})\b", note) for long, short in S.ABBREVIATIONS.items()):
        return True
    score, lo, hi = best_window(term, note)
    if score < 82:
        return False
    lo, end = note.rfind(" ", 0, lo) + 1, note.find(" ", hi)
    return not fuzzy.conflict(term, note[lo : len(note) if end < 0 else end])


def stated(value, note):
    return any(re.search(rf"\b{re.escape(x)}\b", note) for x in (f"{value:.0f}", f"{value:.1f}"))


def invented(note, facts):
    norm, labels = plain(note), [plain(f.text).strip() for f in facts if f.resource == "medications"]
    named = [d for d in S.DRUGS if re.search(rf"\b{d}\b", norm) and not any(d in t or best_window(d, t)[0] >= 82 for t in labels if t)]
    known = {round(f.value, 1) for f in facts if f.resource == "vitals"}
    return named + [m[0] for m in re.finditer(S.BP_PATTERN, note) if float(m[1]) not in known and float(m[2]) not in known]


@tables
def test_anchors_and_faithfulness(spark):
    f, notes = catalog._noted(spark, SF)
    note = {r.row_id: r.note for r in notes.collect()}
    by_row = {}
    for r in f.collect():
        by_row.setdefault(r.row_id, []).append(r)
    check = lambda r: stated(r.value, note[r.row_id]) if r.resource == "vitals" else anchored(r.text, note[r.row_id])
    want = sorted((r.row_id, r.resource, r.pos, check(r)) for rows in by_row.values() for r in rows)
    assert sorted(tuple(r) for r in catalog.anchors(spark, SF).collect()) == want
    lost = {i: sum(not check(r) for r in rows) for i, rows in by_row.items()}
    made = {i: len(invented(note[i], rows)) for i, rows in by_row.items()}
    got = {r.row_id: (r.n_missing, r.n_invented, r.faithful, r.clean) for r in catalog.faithfulness(spark, SF).collect()}
    assert got == {i: (lost[i], made[i], not lost[i], not lost[i] and not made[i]) for i in by_row}


def test_pruned_alignment_is_the_best_window():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(1, n))) for n in (9, 50))
        score, lo, hi = best_window(a, b)
        assert fuzzy.partial_alignment(a, b)[0] == score
        assert fuzzy.partial_alignment(a, b, 82)[0] == (score if score >= 82 else 0.0)


def test_drugs_as_whole_words_in_dictionary_order(spark):
    from quillspark.operators.faithful import drugs_in

    notes = ["takes insulin glargine and aspirin", "aspirins insulin  glargine", "warfarin metformin", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in notes], "n string").select(drugs_in(F.col("n"))).collect()]
    assert got == [["insulin glargine", "insulin", "aspirin"], ["insulin"], ["metformin", "warfarin"], [], None]


def test_rounding_is_printfs(spark):
    rng = random.Random(6)
    values = [round(rng.uniform(-300, 300), rng.randint(1, 2)) for _ in range(10_000)] + [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [0.25, 0.35, 0.05, 98.65, 36.55, 37.45, 2.5, 3.5, -0.04, -0.0, 0.95, 9.95, 99.95, 1e15 + 0.25, float(2**52) - 0.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.printf_whole(F.col("v")).alias("w"), text.printf_tenth(F.col("v")).alias("t")).collect()
    assert all((r.w, r.t) == (f"{r.v:.0f}", f"{r.v:.1f}") for r in got)


def test_similar_terms_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["knee", "left", "right", "pain", "acute", "chronic", "of", "the", "a"]
    terms = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"", "kne pain", "chronc pain", "x"}
    df = spark.createDataFrame([(t,) for t in terms] * 2 + [(None,)], "t string")
    for least in (70, 88, 100):
        want = sorted((a, b, round(s, 6)) for a in terms for b in terms if a < b and (s := fuzzy.token_sort_ratio(a, b)) >= least)
        assert sorted((r.a, r.b, round(r.similarity, 6)) for r in similar.similar_terms(df, "t", least).collect()) == want
    with pytest.raises(ValueError):
        similar.similar_terms(df, "t", 60)


def test_first_rows_without_gathering_them(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(50), f"e{i:04}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(5)
    for n in (1, 700, 2999, 4000):
        got = passes.first_rows(df, n, "a", "b", small=100, bounds=6).collect()
        assert sorted(tuple(r) for r in got) == sorted(rows)[:n]
    assert passes.first_rows(df.withColumn("a", F.lit(1)), 40, "a", small=10).count() == 40


def test_split_tables(spark):
    base = (3, 0.5, 0.4, 1.0, 0.1234, 0.2, {"conditions": 0.5, "vitals": 0.25}, "llm", "notes-v2-100", 0, False, True, ["vitals"], "test")
    rows = [base, (*base[:6], {"conditions": 1.0, "vitals": 0.125}, "regex", None, *base[9:]), (*base[:13], "other")]
    shown = report.split_tables(spark.createDataFrame(rows, S.RESULT).withColumn("path", F.lit("a"))).splitlines()
    assert [x for x in shown if x.startswith("#")] == ["### other (n=3, scored: vitals)", "### test (n=3, scored: vitals)"]
    assert "| Regex baseline | 0.500 | 0.400 | 1.000 | 0.123 | 0.20 |" in shown and "| Regex baseline | 1.000 | 0.125 |" in shown
    assert report.split_tables(spark.createDataFrame(rows, S.RESULT).withColumn("path", F.lit("a")), "other").count("###") == 1


def test_exemplars_settings_and_preflight(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"note": "n1", "label": {"vitals": []}}\n{"note": "n2", "label": {}}\n')
    assert prompts.exemplars(spark, str(path), 1) == [("n1", '{"vitals": []}')]
    assert prompts.exemplars(spark, "nowhere", 0) == []
    with pytest.raises(FileNotFoundError, match="nowhere"):
        prompts.exemplars(spark, "nowhere", 2)
    found = settings.settings({"generation": {"target_pairs": 5}, "splits": {"val": 3}})
    assert (found.seed, found.generation.target_pairs, found.splits["val"]) == (42, 5, 3)
    for bad in ({"sead": 1}, {"generation": {"x": 1}}, {"splits": {"val": -1}}):
        with pytest.raises(ValueError):
            settings.settings(bad)
    completer.preflight(completer.echo)
    with pytest.raises(RuntimeError):
        completer.preflight(lambda prompts: [])
