"""Whole results of the operators that learn, against plain dense computations on small tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality_classifier as qc
from quillspark.llm import quality_rules as qr
from quillspark.llm import sentencepiece_codec as sc
from quillspark.llm import textkernel as tk
from quillspark.llm import toxicity as tx

WORDS = [f"word{i}" for i in range(400)]


def corpus(n=300, seed=3):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = list(rng.choice(WORDS[:250] if good else WORDS[150:], int(rng.integers(1, 120))))
        if not good:
            w = [x.upper() + "###" if rng.random() < 0.5 else x for x in w]
        if i % 5 == 0:
            w[:: max(1, len(w) // 3)] = ["moron"] * len(w[:: max(1, len(w) // 3)])
        docs.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(good), int(i % 5 == 0)))
    docs += [(n, None), (n + 1, ""), (n + 2, "#"), (7, docs[7][1]), (n + 3, docs[9][1] + " " + " ".join(WORDS) * 40)]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def key(r):
    return r.doc_id, round(r.score, 6)


def test_quality_votes(frames):
    docs, labels, df, lab = frames
    m = qc.fit(df, lab)
    learnt = sorted(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    text = dict(reversed(docs))
    assert len(m["y"]) == len(learnt)

    def vector(t):
        d, f, n = qc.features(*tk.pack(pa.array([t], pa.string())))
        a = np.zeros(qc.N_FEATURES)
        a[f] = (1 + np.log(n)) * m["weight"][f]
        v = (a / max(np.linalg.norm(a), 1e-12)) @ m["basis"]
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-6 else v * 0

    known = np.array([vector(min(x for j, x in docs if j == i)) for i in learnt])
    truth = np.array([dict((i, q) for i, q, _ in labels)[i] for i in learnt])
    want = []
    for i, t in docs:
        v = vector(t or "")
        s = np.sort(np.array(list(zip(known @ v, truth)), dtype=[("s", float), ("y", float)]), order="s")[::-1][: qc.K]
        w = np.maximum(s["s"], 0) ** 8
        want.append((i, ((w * s["y"]).sum() + 0.01 * m["prior"]) / (w.sum() + 0.01) if np.abs(v).sum() > 0 else m["prior"]))
    got = sorted((r.doc_id, r.score) for r in qc.score_quality(df, lab, model=m).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=2e-3)
    assert text


def test_quality_rule_verdicts(frames):
    docs, labels, df, lab = frames
    trusted = {i for i, q, _ in labels if q == 1}

    def bins(t):
        buf, off = tk.pack(pa.array([t], pa.string()))
        start, end, doc = tk.words(buf, off)
        return qr.ngram_bins(buf, start, end, doc)[0] if len(start) else np.zeros(0, np.int64)

    each = [(i, bins(t), (t or "").split()) for i, t in docs]
    raw, target = np.zeros(qr.N_BINS), np.zeros(qr.N_BINS)
    for i, b, _ in each:
        for x in b:
            raw[x] += 1
            target[x] += i in trusted
    ratio = np.log((target + 1) / (target.sum() + qr.N_BINS)) - np.log((raw + 1) / (raw.sum() + qr.N_BINS))
    want = []
    for i, b, w in each:
        score = sum(ratio[x] for x in b) / len(b) if len(b) else 0.0
        seen = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(seen) if seen.count(g) > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, failed, not failed and score >= qr.THRESHOLD, round(score, 9)))
    assert sorted((r.doc_id, r.base_failed, r.kept, round(r.score, 9)) for r in qr.apply_rules(df, lab).collect()) == sorted(want)


def test_toxicity_scores(frames):
    docs, labels, df, lab = frames
    m = tx.fit(df, lab)
    index, n_terms = m["index"], len(m["vocabulary"])
    dense = np.zeros((index.n_docs, n_terms))
    for t in range(n_terms):
        for x in range(index.at[t * index.n_blocks], index.at[(t + 1) * index.n_blocks]):
            dense[index.doc[x], t] = index.weight[x]
    assert n_terms and np.allclose(np.linalg.norm(dense, axis=1), 1)
    want = []
    for i, t in docs:
        _, f, n = tx.counts(*tk.pack(pa.array([t], pa.string())), m["vocabulary"])
        q = np.zeros(n_terms)
        q[f] = (1 + np.log(n)) * m["weight"][f]
        if not len(f):
            want.append((i, {round(m["rest"], 6)}))
            continue
        sims = dense @ (q / np.linalg.norm(q))
        order = np.argsort(-sims)
        kth = sims[order[min(tx.K, len(sims)) - 1]]
        sure, tied = sims > kth + 1e-9, np.flatnonzero(np.abs(sims - kth) <= 1e-9)
        room = tx.K - sure.sum()
        votes = set()
        for ones in range(int(m["y"][tied].sum()) + 1):  # whichever of the tied are taken
            if kth > 1e-12 and room - (len(tied) - m["y"][tied].sum()) <= ones <= room:
                total = sims[sure].sum() + kth * min(room, len(tied))
                votes.add(round(((sims[sure] * m["y"][sure]).sum() + kth * ones + 0.5 * m["prior"]) / (total + 0.5), 6))
        if kth <= 1e-12:
            some = sims > 1e-12
            votes.add(round(((sims[some] * m["y"][some]).sum() + 0.5 * m["prior"]) / (sims[some].sum() + 0.5), 6))
        want.append((i, votes))
    got = sorted(key(r) for r in tx.score_toxicity(df, lab).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want, key=lambda x: x[0])]
    allowed = {}
    for i, v in want:
        allowed.setdefault(i, set()).update(v)
    assert all(min(abs(s - v) for v in allowed[i]) < 2e-6 for i, s in got)


def test_a_giant_through_matrices_in_many_tasks(spark):
    rng = np.random.default_rng(5)
    parts = ["internationalisation", "the", "aaaa", "日本語", "ing", "x", "12345", "\n", "😀", "tion", "é"]
    giant = "".join(str(rng.choice(parts)) + (" " if rng.random() < 0.4 else "") for _ in range(150_000))
    bare = "".join(str(rng.choice(["ab", "tion", "é", "zz", "ing"])) for _ in range(9_000))
    docs = [(1, giant), (2, bare), (3, giant[: sc.CHUNK]), (4, giant[: sc.CHUNK - 1]), (1, giant)]
    assert len(giant) > 30 * sc.CHUNK and len(bare) > sc.CHUNK
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sp = sc.codec(sc.default_model()).sp
    want = sorted((i, sp.encode(t)) for i, t in docs)
    got = sc.encode_documents(df, verify=True).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.round_trip == (sp.decode(sp.encode(r.text)) == r.text) for r in got)
