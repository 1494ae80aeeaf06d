import zlib

import numpy as np

from quillspark.llm import toxicity as tx


def test_block_max_index_finds_the_largest_cosines():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, terms = int(rng.integers(1, 90)), int(rng.integers(1, 30))
        dense = np.where(rng.random((n, terms)) < 0.2, rng.random((n, terms)), 0)
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        d, t = np.nonzero(dense)
        index = tx.BlockMaxIndex(d, t, dense[d, t], n, terms, 8)
        q = rng.random(3)
        q /= np.linalg.norm(q)
        at = rng.choice(terms, min(3, terms), replace=False)
        ids, sims = index.nearest(at, q[: len(at)], 5)
        want = np.sort(dense[:, at] @ q[: len(at)])[::-1][:5]
        assert np.allclose(sims, want[want > 1e-12][: len(sims)]) and len(sims) == (want > 1e-12).sum()
        assert np.allclose(dense[ids][:, at] @ q[: len(at)], sims)


def rows(n=400):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    out, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 30))
        bad = int(rng.random() < 0.3)
        if bad:
            w[3] = "Idiot!" if i % 2 else "(scum)"
        out.append((i, " ".join(w), "label"))
        labels.append((i, 1, bad))
    return out, labels


def test_scores_held_out_rows_and_odd_ones(spark):
    docs, labels = rows()
    odd = [(None, "idiot", ""), (1001, None, ""), (1002, "", ""), (5, docs[5][1], "again")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.score_toxicity(df, lab).collect()
    assert len(got) == len(docs) + 4
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert all(r.predicted == truth[r.doc_id] for r in held) and len(held) > 50
    assert {r.predicted for r in got if r.doc_id is None} == {1} and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(e).encode()) % 4 != 2 for r in got for e in r.evidence)


def test_empty_tables(spark):
    docs, labels = rows(20)
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tx.score_toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in tx.score_toxicity(df, lab.limit(0)).collect()} == {0.0}
