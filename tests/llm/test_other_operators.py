"""Mixing, quality rules, HTML text, quality classifier and licences: brute force, held-out accuracy, odd rows."""

import collections
import random
import re
import zlib

import pytest

from quillspark.llm import html_text, licenses, mixing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "a b c", "s", "x"), (900, None, None, "x"), (901, "", "s", None), (902, " \n\t ", "t", "x"), (903, "solo", "", "x"), (903, "solo", "", "x")]


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def targets(sizes):
    """Shares by weight, capped at three times the source, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 20)
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["a"] * 9 + ["b", "c", "é", "z", None]), "k") for i in range(600)]
    df = spark.createDataFrame(rows + ODD, "doc_id long, text string, source string, target string").repartition(3)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) + len(ODD)
    size = collections.Counter()
    for _, t, s, _ in rows + ODD:
        size[s] += len(WORD.findall(t or ""))
    want = targets(size)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in size) and sum(taken.values()) <= sum(size.values())
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def base(text):
    w = WORD.findall(text or "")
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_rules(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        t = "\n".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        t += "\n" + rng.choice(["été ", "same line"] * 3 + [""]) * rng.randint(0, 4)
        if i % 5 == 0:
            t = " ".join(w.upper() + rng.choice(["###", "%%", "!!"]) for w in t.split())
        rows.append((i, t, "s", "x"))
        labels.append((i, int(i % 5 > 0), 0))
    df = spark.createDataFrame(rows + ODD, "doc_id long, text string, source string, kept string").repartition(3)
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(df, lab).collect()
    texts = collections.defaultdict(list)
    for i, t, *_ in rows + ODD:
        texts[i].append(t)
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        want = base(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
        if r.doc_id is not None and r.doc_id < 300 and not r.base_failed:
            assert r.kept == (r.doc_id % 5 > 0)
    assert quality_rules.apply_rules(df.limit(0), lab).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(df, lab.limit(0)).collect())


def test_target_covers_every_trusted_row(spark):
    df = spark.range(25_000).selectExpr("id as doc_id", "concat('w', id, ' Ab', id % 997, '\\n', repeat('x y ', cast(id % 5 as int))) as text")
    lab = spark.range(25_000).selectExpr("id as doc_id", "1 as quality")
    assert abs(quality_rules.fit(df, lab)).max() == 0  # all rows are trusted: target and raw are the same
    some = lab.where("doc_id % 3 > 0")
    want = quality_rules.bin_counts(df.where("doc_id % 3 > 0"))
    assert (quality_rules.trusted_counts(df.repartition(5), some.select("doc_id")) == want).all() and want.sum() > 0


def test_quality_classifier(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        t = words(rng, rng.randint(20, 60))
        if i % 4 == 0:
            t = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: "spam spam " * 20])(t)
        rows.append((i, t, "s", "x"))
        labels.append((i, int(i % 4 > 0), 0))
    df = spark.createDataFrame(rows + ODD, "doc_id long, text string, source string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_classifier.score_quality(df, lab).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and sum(r.predicted == (r.doc_id % 4 > 0) for r in held) > 0.97 * len(held) > 100
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert sorted(map(str, quality_classifier.score_quality(df, flipped).collect())) == sorted(map(str, got))  # held-out labels have no say
    assert quality_classifier.score_quality(df.limit(0), lab).count() == 0
    assert {r.score for r in quality_classifier.score_quality(df, lab.limit(0)).collect()} == {0.5}


def dice(line, template):
    a, b = (set(licenses.bigrams(x)) for x in (line, template))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses(spark):
    rng = random.Random(4)
    lines = [*licenses.TEMPLATES.values(), "plain words only", "all rights", "", "License", "MIT license is the best license of the license world"]
    rows = []
    for i in range(250):
        out = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "LICENSE", "x", "--"]))
                if rng.random() < 0.5:
                    w.pop(rng.randrange(len(w)))
            out.append(" ".join(w))
        rows.append((i, "\n".join(out), "s", "x"))
    df = spark.createDataFrame(rows + ODD, "doc_id long, text string, source string, license string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t, *_ in rows:
        best = [max((dice(line, v), k) for k, v in licenses.TEMPLATES.items()) for line in t.split("\n")]
        top = max((d for d, _ in best), default=0)
        assert got[i].n_lines == sum(d >= 0.8 for d, _ in best), t
        assert got[i].dice == pytest.approx(top if top >= 0.8 else 0.0)
        if top >= 0.8:
            assert got[i].license == min(k for line in t.split("\n") for k, v in licenses.TEMPLATES.items() if dice(line, v) == top)
    assert got[900].license is None and licenses.scan_licenses(df.limit(0)).count() == 0


def best_window(text, templates):
    w, top = licenses.normalise(text), (0.0, "")
    for k, v in templates.items():
        b = set(licenses.bigrams(v))
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + 2 * len(b) + 2) + 1):
                g = set(zip(w[i:j], w[i + 1 : j]))
                d = 2 * len({f"{x} {y}" for x, y in g} & b) / (len(g) + len(b))
                top = max(top, (d, k), key=lambda m: m[0])
    return top


def test_license_passages(spark):
    rng = random.Random(5)
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    said = [("This file is released under the MIT License. See LICENSE.", "MIT")]
    said += [(f"Foo bar\n{wrap(t)}\n\nint main of the thing", k) for k, t in licenses.BODIES.items()]
    said += [(f"All rights reserved\n{wrap(licenses.BODIES['MIT-text'])}", "MIT-text")]
    said += [("Before it. " + " ".join(t.split()) + " After it.", k) for k, t in licenses.BODIES.items()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)] + [(500, None), (501, ""), (502, "word"), (503, "the license of the software is of any kind " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, bodies=licenses.BODIES).collect()}
    assert [(got[i].license, got[i].dice) for i in range(len(said))] == [(k, 1.0) for _, k in said]
    assert all((got[i].license, got[i].dice, got[i].n_lines) == (None, 0.0, 0) for i in range(500, 504))
    few = {k: licenses.TEMPLATES[k] for k in ("MIT", "Proprietary", "ISC", "MIT-notice")}
    texts = []
    for _ in range(60):
        w = " ".join([rng.choice(list(few.values())), "all the rights", rng.choice(list(few.values()))]).split()
        for _ in range(rng.randint(0, 5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "license", "x\n", "\n"]))
            w.pop(rng.randrange(len(w)))
        texts.append(" ".join(w))
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), few, bodies={}).collect()
    for r in rows:
        line = max(dice(x, v) for x in texts[r.doc_id].split("\n") for v in few.values())
        top = line if line >= 0.8 else best_window(texts[r.doc_id], few)[0]
        assert r.dice == pytest.approx(top if top >= 0.8 else 0.0), texts[r.doc_id]


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><ul><li><a href=/>Home</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div><aside><p>Elsewhere on this site there is a long teaser of many words to read</p></aside><MAIN><article><header><h1>The &lt;title&gt; &amp; more</h1><p class="byline">By X</p></header>
<p>First   para&nbsp;graph
with <a href=x>a link</a><!-- gone -->.<ul><li>one<li>two words</ul><form><label>Mail</label><input></form><div class="ad">Buy</div><p>Last.<script>var a="<p>x</p>"</script>
<section id="comments"><article class="comment"><p>I disagree with all of this at length, as ever</p></article></section></article></MAIN><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "The <title> & more\nFirst para graph with a link.\none\ntwo words\nLast."
    assert html_text.main_text(PAGE) == want
    divided = PAGE.replace("<header><h1>The", '<div class="post-header"><h1>The').replace("</p></header>", "</p></div>")
    assert divided != PAGE and html_text.main_text(divided) == want
    assert all(html_text.decide(r[:-1]) == r[-1] for r in html_text.LABELLED)
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>broken <b>bold<p>next &#233; &unknown; <", "x"), (1, "u", PAGE, "x"), (4, "u", "<article>" + "<p>word</p>" * 5000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_text(df).collect()), key=str)
    assert (1, want, len(want)) in got and got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got
    assert (4, "\n".join(["word"] * 5000), 24999) in got
    assert html_text.extract_text(df.limit(0)).count() == 0
