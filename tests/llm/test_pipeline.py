import random
import re

import pytest

import corpus_pipeline as cp
from quillspark.llm import mixing, sentencepiece_codec
from tests.llm.test_shingle_join import brute as near_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(200)]
    long = " ".join(rng.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            w = [x.upper() + "###" for x in w]
        if i % 10 == 3:
            w = w[:20] + long.split() + w[20:]
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
        docs.append((i, " ".join(w), "en", ["a", "b", None, "c"][i % 3]))
    docs += [(200, docs[1][1] + " end", "en", "a"), (201, docs[1][1], "fr", "b"), (202, None, None, None), (203, "", "en", "a"), (None, docs[2][1], "en", "a"), (5, docs[5][1], "en", "c")]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = cp.written(cp.quality(spark, docs, folder))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept >= {i for i in range(120) if i % 4} and not kept & {i for i in range(120) if i % 4 == 0}

    one = cp.written(cp.near_copies(spark, good, folder))
    before = good.collect()
    group = {i: g for i, _, g in near_brute(sorted({(r.doc_id, r.text) for r in before if r.doc_id is not None}))}
    want = sorted(i for i, g in group.items() if i == g)
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == want and sum(r.doc_id is None for r in one.collect()) == 1

    cut = cp.written(cp.repeats(spark, one, folder))
    seen, texts = set(), {}
    for r in sorted(one.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        b = (r.text or "").encode()
        gone = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        texts[r.doc_id] = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in cut.collect()} == texts and all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = cp.written(cp.mixture(spark, cut, folder))
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(cut).collect() if r.taken}
    got = [r.doc_id for r in mixed.collect()]
    assert {i: got.count(i) for i in set(got)} == taken

    out = cp.tokens(spark, mixed, folder).collect()
    sp = sentencepiece_codec.codec(sentencepiece_codec.default_model()).sp
    assert len(out) == len(got) and all(list(r.ids) == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)
    assert rows(cp.run(spark, folder).select("doc_id", "n_tokens")) == sorted(((r.doc_id, r.n_tokens) for r in out), key=str)


def test_tokens_are_decoded(spark):
    texts = ["a b c", "two words\n", "  é  tab\t.", "", "x " * 300]
    out = cp.tokens(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    sp = sentencepiece_codec.codec(sentencepiece_codec.default_model()).sp
    assert {r.doc_id: r.round_trip for r in out} == {i: sp.decode(sp.encode(t)) == t for i, t in enumerate(texts)}


def test_mixture_by_row_where_ids_are_missing_or_repeated(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(word() for _ in range(10)), "en", "ab"[i % 2], 0) for i in range(90)] + [(None, "x y", "en", None, 3), (None, None, None, "a", None), (4, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    want = {}
    for r in mixing.mix_sources(stored, "text").collect():
        if r.taken:
            want[r.doc_id, r.text] = want.get((r.doc_id, r.text), 0) + r.taken // r.size
    for docs in (stored, df):
        got = [(r.doc_id, r.text) for r in cp.mixture(spark, docs, "").collect()]
        assert sum(want.values()) == len(got) and set(got) <= {(r[0], r[1]) for r in rows}
        if docs is stored:
            assert {k: got.count(k) for k in set(got)} == want
    assert cp.mixture(spark, stored.limit(0), "").count() == 0


def test_stages_keep_an_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, row long, kept string, body binary")
    for stage in (cp.near_copies, cp.repeats, cp.mixture):
        assert stage(spark, docs, "").count() == 0
    full = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11, 1, 2, "k", None), (2, "a b c d e f", "en", "s", 11, 1, 2, "k", None)], docs.schema)
    assert [r.doc_id for r in cp.near_copies(spark, full, "").collect()] == [1]
    assert cp.repeats(spark, full, "").columns == list(cp.COLUMNS) and cp.mixture(spark, full, "").columns == list(cp.COLUMNS)
