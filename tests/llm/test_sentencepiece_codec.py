import random

import numpy as np
import pytest

sc = pytest.importorskip("quillspark.llm.sentencepiece_codec")
pytest.importorskip("sentencepiece")


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "internationalisation", "aaaaaaaa", "é", "日本", "x", "   ", "\n", "12345", "<0x0A>", "Hello", "ing", "​", "😀", "!!!", "tion"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_chunks_of_any_size_give_the_librarys_ids():
    c = sc.codec(sc.default_model())
    for t in texts(1, 120):
        want = c.sp.encode(t)
        for size in (1, 3, 7, 40, 90):
            assert c.encode(t, size) == want, (size, t)
        assert c.sp.decode(want) == t


def test_long_text_without_spaces():
    c = sc.codec(sc.default_model())
    rng = random.Random(2)
    t = "".join(rng.choice("abcdeétion") for _ in range(3000))
    assert c.encode(t, 500) == c.sp.encode(t)


def test_scan_is_the_sequential_product():
    rng = np.random.default_rng(3)
    m = [np.where(rng.random((a, b)) < 0.3, sc.NEVER, rng.integers(0, 9, (a, b)).astype(float)) for a, b in [(1, 3), (3, 2), (2, 5), (5, 4), (4, 1)]]
    want = [m[0]]
    for x in m[1:]:
        want.append(sc.product(want[-1], x))
    assert all((a == b).all() for a, b in zip(sc.scan(m), want))


def test_documents_and_giants(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(texts(4, 25))] + [(98, None, 1), (99, "", 1), (None, "a b", 1), (3, "same text " * 40, 1), (3, "same text " * 40, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    sp = sc.codec(sc.default_model()).sp
    got = sc.decode_documents(sc.encode_documents(df, None, 50, 120, ("k",)), None, "text").collect()
    want = sorted(((i, t, sp.encode(t or "")) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.text, list(r.ids)) for r in got), key=str) == want
    assert all(r.decoded == (r.text or "") for r in got)
    assert sc.encode_documents(df.limit(0)).count() == 0
    checked = sc.encode_documents(df, None, 50, 120, verify=True).collect()
    assert len(checked) == len(rows) and all(r.round_trip for r in checked)
