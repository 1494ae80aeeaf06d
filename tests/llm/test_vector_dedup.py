import math

import numpy as np
import pytest

from quillspark.llm import vector_dedup as vd


def brute(rows, cosine=0.98):
    good = [(i, np.asarray(e, float), lab) for i, e, lab in rows if i is not None and e is not None and lab is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n, parent = [0] * len(good), list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(good):
        least[find(k)] = min(least.get(find(k), i), i)
    out = [(i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(good)]
    known = {i for i, _, _ in good}
    return sorted(out + [(i, 0, i, True) for i, _, _ in rows if i is not None and i not in known])


def rows(seed, dim, n=160):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(8)] + rng.standard_normal(dim) * rng.choice([0.0, 0.08, 0.14, 0.6])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) % 2))
    return out + [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, out[3][1], None), (n + 5, out[3][1], out[3][2]), (n + 6, [2 * x for x in out[5][1]], out[5][2]), (n + 7, [1e30] * dim, 0), (n + 8, [], 0), (n + 9, [float("inf")] + [0.0] * (dim - 1), 0)]


@pytest.mark.parametrize(("seed", "dim", "tile"), [(1, 16, 512), (2, 24, 7), (3, 5, 16)])
def test_equals_all_pairs_compared(spark, seed, dim, tile):
    data = rows(seed, dim)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(tuple(r) for r in vd.near_vectors(df, tile=tile).collect())
    assert got == brute(data)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 2), (None, [1.0, 0.0], 1, 2)], "vec_id long, embedding array<double>, label int, n int")
    got = vd.near_vectors(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (None, 0, None, True)}
    assert vd.near_vectors(df.limit(0)).count() == 0


def test_a_tile_keeps_all_connections():
    rng = np.random.default_rng(4)
    for _ in range(200):
        m = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.choice([0.02, 0.06, 0.3])
        thin = np.zeros_like(m)
        thin[vd.spanning(m)] = True
        assert not (thin & ~m).any()
        reach = [np.linalg.matrix_power(np.eye(len(x)) + (x.astype(float) @ x.T > 0), 40) > 0 for x in (m, thin)]
        assert (reach[0] == reach[1]).all() and (m.any(0) == thin.any(0)).all() and (m.any(1) == thin.any(1)).all()


def test_rows_of_one_id_keep_their_own_vectors(spark):
    data = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (4, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    want = sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True)])
    assert sorted(tuple(r) for r in vd.near_vectors(df).collect()) == want == brute(data)


def test_one_crowded_cell_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vd, "CELL_ROWS", 200)
    monkeypatch.setattr(vd, "VECTOR_ROWS", 50)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    data = [(i, [float(x) for x in centre + rng.standard_normal(16) * (0.05 if i % 3 else 0.2)], 1) for i in range(150)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    assert sorted(tuple(r) for r in vd.near_vectors(df, tile=20).collect()) == brute(data)
