import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import suffix_dedup as sd
from quillspark.llm.textkernel import pack


def brute(docs, length):
    """docs: [(id, text)]; the spans removed of each, by comparing every window."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0], r[1]))
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    import quillspark.llm.suffix_dedup as m
    from pyspark.sql import functions as F

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "é", "xyz", "the", "q", "lorem", "ß"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(5, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(1, 30)) for _ in range(rng.randint(0, 4))]
        docs.append((i, " ".join(parts)))
    docs += [(n, "a" * 300), (n + 1, "a" * 200 + "b"), (n + 2, None), (n + 3, ""), (n + 4, docs[3][1]), (n + 5, "xy" * 80), (n + 5, "xy" * 80)]
    return docs


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 20, 6), (2, 100, 32), (3, 33, 9)])
def test_equals_every_window_compared(spark, monkeypatch, seed, length, gram):
    monkeypatch.setattr("quillspark.llm.exchange.BLOCK_BYTES", 700)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(sd.find_repeats(df, length, gram)) == brute(docs, length)


def test_nulls_empty_tables_and_other_columns(spark):
    long = "lorem ipsum dolor " * 12
    df = spark.createDataFrame([(None, long, "a"), (1, long, "b"), (2, None, None)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in sd.find_repeats(df.withColumnRenamed("kept", "block"), 100, 32).collect()}
    assert got[None].kept == b"" and got[2].n_bytes == 0 and got[1].spans
    assert sd.find_repeats(df.limit(0)).count() == 0
    assert sd.find_repeats(df.withColumnRenamed("kept", "source"), 100, 32, "source").columns == ["doc_id", "source", "n_bytes", "spans", "kept"]


def test_deep_shallow_sorts_suffixes():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(400)) * 2
    buf, _ = pack(__import__("pyarrow").array([text]))
    lo = np.arange(0, 700)
    order, group = sd.deep_shallow(buf, lo, lo + 60, 32)
    got = [text[i : i + 60] for i in order]
    assert got == sorted(got)
    assert all((a == b) == (g == h) for a, b, g, h in zip(got, got[1:], group, group[1:]))
