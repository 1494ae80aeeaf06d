import random
import re

import pytest

from quillspark.llm import shingle_join as sj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if n and 100 * n >= 80 * (len(x) + len(y) - n):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted((i, len(x), find(i)) for i, x in sets)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 6, 9, 12, 15, 40, 90, 200]))] for _ in range(25)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
        docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, docs[0][1]), (n + 4, docs[0][1].replace(" ", "\n\t"))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs_compared(spark, monkeypatch, seed):
    monkeypatch.setattr("quillspark.llm.exchange.BLOCK_BYTES", 4000)
    monkeypatch.setattr(sj, "TILE", 5)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in sj.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(docs)


def test_every_linked_pair_shares_an_indexed_key():
    rng = random.Random(3)
    import numpy as np

    from quillspark.llm.textkernel import salted

    universe = salted(99, 5000)
    for _ in range(3000):
        n = rng.randint(1, rng.choice([12, 20, 60, 400]))
        x = np.unique(rng.sample(list(universe), n))
        drop = rng.randint(0, n // 9)
        y = np.unique(list(x[drop:]) + rng.sample(list(universe), rng.randint(0, n // 10)))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        keys = []
        for s in (x, y):
            found = set()
            k, _, group, need, _ = sj._keys([s], 80, 1.5)
            for g in range(len(need)):
                found |= set(sorted(k[group == g])[: need[g]])  # any common order will do
            keys.append(found)
        assert keys[0] & keys[1]


def test_null_ids_repeated_rows_and_other_columns(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (2, text + " eight nine", 4), (7, "x", 5), (None, "other", 6)], "doc_id long, text string, representative long")
    got = sorted((((r.doc_id is None, r.doc_id or 0), r.component_id) for r in sj.near_duplicates(df).collect()), key=str)
    assert got == [((False, 2), 2), ((False, 4), 4), ((False, 4), 4), ((False, 7), 7), ((True, 0), 4), ((True, 0), None)]
    assert sj.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.exchange.BLOCK_BYTES", 20_000)
    monkeypatch.setattr(sj, "TILE", 16)
    monkeypatch.setattr(sj, "PAIR_ROWS", 300)
    monkeypatch.setattr(sj, "BODY_ROWS", 100)
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    docs = []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(0, 5)):
            w[at] = f"x{i}"
        docs.append((i, " ".join(w)))
    long = [f"v{rng.randrange(90_000)}" for _ in range(60_000)]
    other = [f"z{i}" if i % 100 == 0 else x for i, x in enumerate(long)]
    far = [f"z{i}" if i % 10 == 0 else x for i, x in enumerate(long)]
    docs += [(300, " ".join(long)), (301, " ".join(other)), (302, " ".join(far))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in sj.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()) == brute(docs)


def test_parity_maps_never_differ_in_more_bits_than_the_sets():
    import numpy as np

    from quillspark.llm.textkernel import salted

    rng, universe = random.Random(5), list(salted(7, 3000))
    sets = []
    for _ in range(60):
        x = rng.sample(universe, rng.randint(1, 600))
        sets += [np.unique(x), np.unique(x[rng.randint(0, 5) :] + rng.sample(universe, rng.randint(0, 20)))]
    maps = sj.Maps([sj.parity_map(s) for s in sets])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (maps.differ(x, y) <= apart).all()


def test_firsts_and_what_stays(spark):
    a, b = "one two three four five six seven", "un deux trois quatre cinq six sept"
    rows = [(9, a, "p"), (3, a, "q"), (3, b, "r"), (None, a, "s"), (None, a, "t"), (None, b + " huit neuf dix", "u"), (5, "", "v"), (6, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((r.row for r in sj.without_copies(df, "row").collect()))
    assert [k for k in kept if k not in "st"] == ["q", "r", "u", "v", "w"] and sum(k in "st" for k in kept) == 1
    assert {r.row: r.text for r in sj.without_copies(df, "row").collect() if r.row in "vw"} == {"v": "", "w": None}
