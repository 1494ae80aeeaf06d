"""Embedding near-duplicates by a subspace pigeonhole join, verified exactly.

Unit vectors with cosine >= c are at a squared distance of at most r2 = 2 (1 - c). Vectors are
turned by a fixed random rotation and split into blocks of BLOCK dimensions. Each block gets a
share of r2 in proportion to its variance over the table, so for a linked pair some block's squared distance is within
its share. In each block, a range join on a grid finds the pairs within the share: a vector
lies in one cell (of GRID of the block's dimensions, WIDTH times the radius wide) and probes
the cells that its ball touches. The union over blocks is verified by the exact cosine in
double precision. A pair counts only at the first block that finds it, so link counts are exact.

Vectors with equal label and equal components form a class that is represented once and
counts by its size. Cells are worked on in tiles of TILE by TILE vectors, dealt out as
tasks of their own, so that a crowded cell is shared between tasks. To the tiles go the
block's few coordinates; only vectors with a candidate in a tile fetch their components there.
No pair is ever a row: a tile returns, for each vector, how many links it found, and a
spanning forest of them.

Only rows with equal labels are compared. Null vectors or labels, zero vectors, and those with null
or non-finite components link with nothing; vectors of different length don't link either.
Null ids make no links. Ties and repeated rows count as vectors each, whether rows of a vec_id
have equal vectors or not; each row then has the links of its own vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import heavy_keys, join_split, table, written

COSINE, BLOCK, GRID, WIDTH, TILE = 0.98, 8, 3, 6.0, 4096
CELL_ROWS, VECTOR_ROWS = 200_000, 10_000  # rows of a task: with a block's coordinates, and with whole vectors
_EPS = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shares(variance: np.ndarray, r2: float, block: int) -> np.ndarray:
    """Each block's part of the squared distance, in proportion to its variance, and a little more for rounding."""
    cuts = np.arange(0, len(variance), block)
    v = np.add.reduceat(np.maximum(variance, 0), cuts) + 1e-9
    return r2 * v / v.sum() + 1e-9


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the norm of huge or tiny numbers overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(z: np.ndarray, radius: float, grid: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, role) of the cells that each row's ball touches; role 2: the cell it lies in. z: a block's coordinates."""
    g = z[:, :grid] / (width * radius)
    own = np.floor(g).astype(np.int64)
    low, high = np.floor(g - 1 / width).astype(np.int64), np.floor(g + 1 / width).astype(np.int64)
    row, cell = np.arange(len(z)), own[:, :0]
    for d in range(g.shape[1]):  # one dimension after the other; a ball touches at most two cells in each
        two = np.flatnonzero(high[row, d] > low[row, d])
        row, cell = np.concatenate((row, row[two])), np.vstack((np.column_stack((cell, low[row, d])), np.column_stack((cell[two], high[row[two], d]))))
    return row, cell, np.where((cell == own[row]).all(1), 2, 1)


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (rows, columns), of what the matrix links."""
    rows, cols, todo = [], [], linked.any(1)
    while todo.any():
        front = np.zeros(len(linked), bool)
        front[todo.argmax()] = True
        seen = np.zeros(linked.shape[1], bool)
        while front.any():
            todo &= ~front
            at = np.flatnonzero(front)
            new = linked[at].any(0) & ~seen
            c = np.flatnonzero(new)
            rows.append(at[linked[np.ix_(at, c)].argmax(0)])
            cols.append(c)
            seen |= new
            front = linked[:, new].any(1) & todo
            at = np.flatnonzero(front)
            rows.append(at)
            cols.append(c[linked[np.ix_(at, c)].argmax(1)] if len(at) else c[:0])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of y, but for rounding."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


def tile_links(x: np.ndarray, z: np.ndarray, ids: np.ndarray, own: np.ndarray, probe: np.ndarray, b: int, share: np.ndarray, block: int, cosine: float) -> np.ndarray:
    """Which probing rows link with which own rows, by pairs that block b is the first to find.

    Matrix products decide all but what lies within rounding of a limit; that is summed up pair by
    pair, always in one way, so that two tiles never judge a pair differently.
    """
    cuts = np.arange(0, x.shape[1], block)
    out = np.zeros((len(probe), len(own)), bool)
    step = max(1, (1 << 21) // len(own))
    for lo in range(0, len(probe), step):
        some = probe[lo : lo + step]
        d2 = squared(z[some, cuts[b] : cuts[b] + block], z[own, cuts[b] : cuts[b] + block])
        maybe = (d2 <= share[b] + _EPS) & (ids[some][:, None] != ids[own][None])
        if not maybe.any():
            continue
        sure = maybe & (d2 <= share[b] - _EPS)
        cos = x[some] @ x[own].T
        maybe &= cos >= cosine - _EPS
        sure &= cos >= cosine + _EPS
        for k in range(b):
            if not maybe.any():
                break
            d2 = squared(z[some, cuts[k] : cuts[k] + block], z[own, cuts[k] : cuts[k] + block])
            maybe &= d2 > share[k] - _EPS
            sure &= d2 > share[k] + _EPS
        p, o = np.nonzero(maybe & ~sure)
        for at in range(0, len(p), 20_000):
            pp, oo = p[at : at + 20_000], o[at : at + 20_000]
            parts = np.add.reduceat((z[some[pp]] - z[own[oo]]) ** 2, cuts, axis=1)
            sure[pp, oo] = (parts[:, b] <= share[b]) & (parts[:, :b] > share[:b]).all(1) & (np.einsum("ij,ij->i", x[some[pp]], x[own[oo]]) >= cosine)
        out[lo : lo + step] = sure
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept for each row."""
    e = F.col("embedding")
    numbers = F.transform(e, lambda x: x.cast("double"))
    sane = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("good", F.coalesce(sane & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    marks = ["label", "dim", "p", "q"]
    good = rows.where("good").select("vec_id", "embedding", "label", F.size("embedding").alias("dim"), F.xxhash64(numbers).alias("p"), F.xxhash64(F.lit(1), numbers).alias("q"))
    good = written(good.withColumn("row", F.monotonically_increasing_id()))
    classes = written(good.groupBy(*marks).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("row").alias("id")))
    heads = written(good.select(F.col("row").alias("id"), "embedding").join(classes.select("id", "label", "dim", "n"), "id"))
    r2 = 2 * (1 - cosine)
    models = {}
    for r in heads.select("dim").distinct().collect():
        dim = r["dim"]
        turn = rotation(dim)

        def moments(batches, dim=dim, turn=turn):
            total = np.zeros((3, dim))
            for b in batches:
                if b.num_rows:
                    z = unit_rows(b.column("embedding"), dim) @ turn
                    total += np.stack((np.full(dim, len(z)), z.sum(0), (z * z).sum(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, total)], ["d", "n", "s", "q"])

        t = np.array([tuple(x) for x in heads.where(F.col("dim") == dim).select("embedding").mapInArrow(moments, "d int, n double, s double, q double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("d").collect()])
        models[dim] = turn, shares(t[:, 3] / t[:, 1] - (t[:, 2] / t[:, 1]) ** 2, r2, block)

    def place(batches):
        """For each vector and block: the cell it lies in and probes (role 2) and those it only probes (role 1), with its coordinates."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                turn, share = models[dim]
                z = unit_rows(part.column("embedding"), dim) @ turn
                for b, v in enumerate(share):
                    own = z[:, b * block : (b + 1) * block]
                    at, cell, role = cells_of(own, math.sqrt(v), grid)
                    idx, few = pa.array(at), own[at].astype(np.float32)
                    off = np.arange(len(at) + 1, dtype=np.int32) * (4 * own.shape[1])
                    coordinates = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(few.tobytes())])
                    names = pa.array([",".join(map(str, c)) for c in cell.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("id").take(idx), part.column("label").take(idx), part.column("dim").take(idx), pa.array(np.full(len(at), b, np.int32)), names, pa.array(role.astype(np.int32)), coordinates], ["id", "label", "dim", "block", "cell", "role", "z"])

    label_type = heads.schema["label"].dataType.simpleString()
    placed = heads.select("id", "label", "dim", "embedding").mapInArrow(place, f"id long, label {label_type}, dim int, block int, cell string, role int, z binary")
    # cells by 96 bits of label, size, block and place
    name = [F.xxhash64("label", "dim", "block", "cell").alias("key"), F.hash("cell", "block", "dim", "label").alias("check")]
    placed = written(placed.select("id", "dim", "block", *name, "role", "z"))
    key = ["key", "check"]
    crowd = placed.groupBy(*key).agg(F.count_if(F.col("role") == 2).alias("n_own"), F.count(F.lit(1)).alias("n_probe")).where("n_own > 0 and n_probe > 1")
    crowd = crowd.select(*key, F.ceil(F.col("n_own") / tile).cast("int").alias("own_tiles"), F.ceil(F.col("n_probe") / tile).cast("int").alias("probe_tiles"))
    some = placed.join(crowd, key).withColumn("i0", F.pmod(F.xxhash64("id"), F.col("own_tiles")).cast("int")).withColumn("j0", F.pmod(F.xxhash64("id", F.lit(1)), F.col("probe_tiles")).cast("int"))
    # as the one compared with, a vector goes to a row of tiles; as the one that probes, to a column; where they cross, once
    common = [*key, "dim", "block", "id", "z"]
    lying = some.where("role = 2").select(*common, F.col("i0").alias("i"), F.explode(F.sequence(F.lit(0), F.col("probe_tiles") - 1)).alias("j"), F.lit(True).alias("own"), "j0").withColumn("probe", F.col("j") == F.col("j0")).drop("j0")
    probing = some.select(*common, F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1)).alias("i"), F.col("j0").alias("j"), "role", "i0").where("role = 1 or i <> i0").drop("role", "i0").withColumn("own", F.lit(False)).withColumn("probe", F.lit(True))

    def dealt(rows: DataFrame, n_rows: int, per_task: int):
        n = max(1, -(-n_rows // per_task))
        return rows.withColumn("bucket", F.pmod("key", F.lit(n))).groupBy("bucket", "i", "j")

    def cells(rows: pa.Table):
        """The rows of each cell: their numbers, the cell's dim and block, those that lie in it and those that probe it."""
        key, check = rows.column("key").to_numpy(), rows.column("check").to_numpy()
        order = np.lexsort((check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        cut = np.flatnonzero(new)
        own, probe = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("own", "probe"))
        dim, blk = rows.column("dim").to_numpy(), rows.column("block").to_numpy()
        for lo, hi in zip(cut, [*cut[1:], len(order)]):
            at = order[lo:hi]
            if own[at].any() and probe[at].any():
                yield at, int(dim[at[0]]), int(blk[at[0]]), np.flatnonzero(own[at]), np.flatnonzero(probe[at])

    def hopeful(rows: pa.Table) -> pa.Table:
        """The rows that have a pair within the block's share in this tile; coordinates are rounded, so a little more counts."""
        rows = rows.combine_chunks()
        ids, bodies = rows.column("id").to_numpy(), rows.column("z").to_pylist()
        hit = np.zeros(len(ids), bool)
        for at, dim, b, own, probe in cells(rows):
            z = np.frombuffer(b"".join([bodies[i] for i in at]), np.float32).reshape(len(at), -1).astype(np.float64)
            limit = models[dim][1][b] * 1.001 + 1e-6
            step = max(1, (1 << 21) // len(own))
            for lo in range(0, len(probe), step):
                near = (squared(z[probe[lo : lo + step]], z[own]) <= limit) & (ids[at[probe[lo : lo + step]]][:, None] != ids[at[own]][None])
                hit[at[probe[lo : lo + step][near.any(1)]]] = True
                hit[at[own[near.any(0)]]] = True
        return rows.drop_columns(["z", "bucket"]).filter(pa.array(hit))

    def compare(rows: pa.Table) -> pa.Table:
        """A tile's links: for each probing vector how many it finds here, and one vector that it links with; and a forest of them."""
        rows = rows.combine_chunks()
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        vectors = rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding")
        out = [[], [], []]
        for at, dim, b, own, probe in cells(rows):
            turn, share = models[dim]
            x = unit_rows(vectors.take(pa.array(at)), dim)
            links = tile_links(x, x @ turn, ids[at], own, probe, b, share, block, cosine)
            hit = np.flatnonzero(links.any(1))
            if not len(hit):
                continue
            r, c = spanning(links)
            mine, theirs = ids[at[probe]], ids[at[own]]
            out[0] += [mine[hit], theirs[c]]
            out[1] += [theirs[links[hit].argmax(1)], mine[r]]
            out[2] += [links[hit] @ n[at[own]], np.zeros(len(c), np.int64)]
        return pa.table([pa.array(np.concatenate(v).astype(np.int64) if v else [], pa.int64()) for v in out], ["id", "with", "found"])

    every = lying.unionByName(probing)
    near = written(dealt(every, placed.count(), CELL_ROWS).applyInArrow(hopeful, "key long, check int, dim int, block int, id long, i int, j int, own boolean, probe boolean"))
    tiles = written(dealt(near.join(heads.select("id", "n", "embedding"), "id"), near.count(), VECTOR_ROWS).applyInArrow(compare, "id long, with long, found long"))
    linked = tiles.groupBy("id").agg(F.sum("found").alias("found"))
    where = written(components(tiles, "id", "with"))
    named = where.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(linked, "id", "left").join(where.join(named, "component").select("id", "component_id"), "id", "left")
    known = known.select(*marks, (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    heavy = heavy_keys(classes, "n", marks, good.count())
    out = join_split(good.select("vec_id", *marks), known, marks, heavy).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
