"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

1. Every word gives hashed features: its lower-cased self, its shape (letter case,
   digits and symbols with runs collapsed), the shapes of two neighbours, and whether
   it repeats one of the three words before it.
2. Document frequencies of all features are counted over the whole corpus.
3. At most MAX_TRAIN labelled rows become TF-IDF vectors; their leading RANK right
   singular vectors (latent-semantic analysis, randomised SVD) make the projection.
4. The labelled vectors, whose size is fixed by MAX_TRAIN and RANK, are broadcast. Each
   document takes exact cosine products with all of them, in blocks, and its K nearest
   vote with their similarity.

Labels come only from rows whose crc32(doc_id) mod 3 isn't 1; only the text is scored.
A null or empty text, or one that resembles nothing labelled, gets the labelled share of
label 1. Without labelled rows every score is 0.5. Null ids keep a null held_out.
Repeated rows are scored each. Ties in similarity go to the labelled row that is first
by hash of its id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.shared import crc_mod, labelled_sample, table

MAX_TRAIN, RANK, K, THRESHOLD = 3000, 48, 15, 0.5
N_WORD, N_SHAPE, N_PAIR, N_LAG = 4096, 1024, 2048, 4
N_FEATURES = N_WORD + N_SHAPE + N_PAIR + N_LAG

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), sorted, of a pack."""
    start, end, doc = tk.words(buf, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = tk.spans_hash(buf, start, end, tk.BYTE[tk.LOWER])
    kind = _CLASS[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    kept = np.flatnonzero(first)
    shape = tk.spans_hash(kind[kept], np.searchsorted(kept, start), np.searchsorted(kept, end))
    pair, at = tk.grams(shape, doc, 2)
    bins = [(word % tk.U64(N_WORD)).astype(np.int64), (shape % tk.U64(N_SHAPE)).astype(np.int64) + N_WORD, (pair % tk.U64(N_PAIR)).astype(np.int64) + N_WORD + N_SHAPE]
    docs = [doc, doc, doc[at]]
    for lag in (1, 2, 3):
        if len(word) > lag:
            same = np.flatnonzero((word[lag:] == word[:-lag]) & (doc[lag:] == doc[:-lag])) + lag
            bins.append(np.full(len(same), N_FEATURES - N_LAG + lag - 1))
            docs.append(doc[same])
    return tk.counts_by_doc(np.concatenate(docs), np.concatenate(bins), N_FEATURES)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents have each feature, over all of them; the last number counts the documents."""

    def count(batches):
        total = np.zeros(N_FEATURES + 1, np.int64)
        for b in tk.slices(batches):
            _, f, _ = features(*tk.pack(b.column("text")))
            total[:N_FEATURES] += np.bincount(f, minlength=N_FEATURES)
            total[-1] += b.num_rows
        if total[-1]:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["f", "n"])

    out = np.zeros(N_FEATURES + 1)
    for r in docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return out


def idf(df: np.ndarray) -> np.ndarray:
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)


def project(d: np.ndarray, f: np.ndarray, n: np.ndarray, n_docs: int, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the documents; zero rows where there is nothing to go by."""
    out = np.zeros((n_docs, basis.shape[1]), np.float32)
    step = 400_000
    cuts = [0]
    while cuts[-1] < len(d):  # never inside a document
        cuts.append(int(np.searchsorted(d, d[min(cuts[-1] + step, len(d)) - 1], "right")))
    for a, b in zip(cuts, cuts[1:]):
        w = ((1 + np.log(n[a:b])) * weight[f[a:b]]).astype(np.float32)
        which, at = np.unique(d[a:b], return_index=True)
        norm = np.sqrt(np.add.reduceat(w * w, at))
        out[which] = np.add.reduceat(basis[f[a:b]] * w[:, None], at) / np.maximum(norm, 1e-12)[:, None]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, rank: int = RANK) -> dict:
    """The model: feature weights, projection, labelled vectors and labels. Its size is bounded by the parameters."""
    def counted(batches):
        """The features of the labelled texts: what the driver gets is bounded by rows and features, however long a text is."""
        for b in tk.slices(batches):
            d, f, n = features(*tk.pack(b.column("text")))
            cut = pa.array(np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (f, n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *lists], ["doc_id", "label", "f", "n"])

    sample = labelled_sample(docs, labels, "quality", 3, 1, max_train).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    rows = sample.mapInArrow(counted, "doc_id long, label int, f array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    weight = idf(document_frequencies(docs))
    y = rows.column("label").to_numpy().astype(np.float32)
    f, n = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) if len(y) else np.zeros(0, np.int64) for c in ("f", "n"))
    d = np.repeat(np.arange(len(y)), pc.list_value_length(rows.column("f")).to_numpy()) if len(y) else np.zeros(0, np.int64)
    a = np.zeros((len(y), N_FEATURES), np.float32)
    a[d, f] = (1 + np.log(n)) * weight[f]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    rank = max(1, min(rank, *a.shape)) if len(y) else 1
    if len(y):
        q = a @ np.random.default_rng(5).standard_normal((N_FEATURES, rank + 8)).astype(np.float32)
        for _ in range(2):
            q = a @ (a.T @ np.linalg.qr(q)[0])
        basis = np.linalg.svd(np.linalg.qr(q)[0].T @ a, full_matrices=False)[2][:rank].T
    else:
        basis = np.zeros((N_FEATURES, 1), np.float32)
    basis = np.ascontiguousarray(basis, np.float32)
    return {"weight": weight, "basis": basis, "x": project(d, f, n, len(y), weight, basis), "y": y, "prior": float(y.mean()) if len(y) else 0.5}


def votes(v: np.ndarray, model: dict, k: int = K) -> np.ndarray:
    """Scores of unit vectors: labels of the k nearest weighted by similarity, with one vote of the prior's."""
    out = np.full(len(v), model["prior"])
    k = min(k, len(model["y"]))
    for a in range(0, len(v), 512):
        if not k:
            break
        sim = v[a : a + 512] @ model["x"].T
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        s = np.maximum(np.take_along_axis(sim, near, 1).astype(np.float64), 0) ** 8
        out[a : a + 512] = ((s * model["y"][near]).sum(1) + 0.01 * model["prior"]) / (s.sum(1) + 0.01)
    return np.where(np.abs(v).sum(1) > 0, out, model["prior"])


def score_quality(docs: DataFrame, labels: DataFrame, *keep: str, max_train: int = MAX_TRAIN, k: int = K, model: dict | None = None) -> DataFrame:
    """docs(doc_id, text, keep...) -> doc_id, keep..., held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model or fit(docs, labels, max_train)))

    def score(batches):
        m = pickle.loads(shared.value)
        for b in tk.slices(batches):
            d, f, n = features(*tk.pack(b.column("text")))
            s = votes(project(d, f, n, b.num_rows, m["weight"], m["basis"]), m, k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in keep], b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", *keep, "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in keep if c != "text"], (crc_mod("doc_id", 3) == 1).alias("held_out"))
    carried = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(score, f"doc_id long{carried}, held_out boolean, score double, predicted int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
