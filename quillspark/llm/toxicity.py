"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

1. At most MAX_TRAIN labelled rows are the examples; those with the same words count as one,
   which has the larger label. Their words (lower case, without
   punctuation and symbols at the ends) that go with the label beyond chance make the
   vocabulary: at most MAX_TERMS, by a signed log-likelihood ratio.
2. The vocabulary's document frequencies are counted over the whole corpus.
3. The examples' unit TF-IDF vectors go into an inverted index in blocks of BLOCK
   examples, which keeps each term's largest weight in each block. The index is bounded
   by MAX_TRAIN and MAX_TERMS and is broadcast.
4. A block is visited by those documents only whose upper bound there exceeds the K-th best
   cosine they have found so far, so the K largest cosines are exact. A pass over the blocks
   serves a batch of documents at once.
5. The neighbours' labels are weighted by cosine and shrunk towards the share of label 1
   among examples; the neighbours' ids are the evidence.

Labels come only from rows whose crc32(doc_id) mod 4 isn't 2; only the text is scored.
A text without vocabulary (null, empty, unknown words) gets the share of label 1 among
the examples without vocabulary. Without labelled rows every score is 0. Ties in cosine
go to the earlier example in the index. Repeated rows are scored each.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.shared import crc_mod, labelled_sample, table

MAX_TRAIN, MAX_TERMS, BLOCK, K, THRESHOLD, LEAST_LLR = 12_000, 4096, 256, 15, 0.3, 15.0

_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation at their ends and their documents."""
    start, end, doc = tk.words(buf, off)
    start, end = start.copy(), end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live]) & _EDGE[buf[np.minimum(start[live], len(buf) - 1)]]]
        start[live] += 1
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live]) & _EDGE[buf[end[live] - 1]]]
        end[live] -= 1
    some = start < end
    start, end, doc = start[some], end[some], doc[some]
    return tk.spans_hash(buf, start, end, tk.BYTE[tk.LOWER]), doc


def counts(buf: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the words in the sorted vocabulary."""
    h, doc = terms(buf, off)
    at = np.searchsorted(vocabulary, h)
    hit = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
    return tk.counts_by_doc(doc[hit], at[hit], max(1, len(vocabulary)))


class BlockMaxIndex:
    """Exact top-k by cosine over unit vectors of examples, kept as postings by (term, block)."""

    def __init__(self, d, t, w, n_docs: int, n_terms: int, block: int):
        self.block, self.n_blocks = block, max(1, -(-n_docs // block))
        order = np.lexsort((d, t))
        self.doc, self.weight = d[order], w[order]
        key = t[order] * self.n_blocks + self.doc // block
        self.at = np.searchsorted(key, np.arange(n_terms * self.n_blocks + 1))
        self.top = np.zeros(n_terms * self.n_blocks, np.float64)
        np.maximum.at(self.top, key, self.weight)
        self.top = self.top.reshape(n_terms, self.n_blocks)
        self.n_docs, self.parts = n_docs, {}

    def part(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's terms, and their weights as rows over its examples."""
        if b not in self.parts:
            terms = np.flatnonzero(self.top[:, b] > 0)
            rows = np.zeros((len(terms), self.block))
            for i, t in enumerate(terms):
                lo, hi = self.at[t * self.n_blocks + b], self.at[t * self.n_blocks + b + 1]
                rows[i, self.doc[lo:hi] - b * self.block] = self.weight[lo:hi]
            self.parts[b] = terms, rows
        return self.parts[b]

    def nearest_all(self, d: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For n vectors (d, t, w; d ascending, each vector with a term) the k examples of largest cosine above 0, and the cosines.

        Blocks are visited in order, each by those vectors only whose bound there exceeds the
        k-th best cosine they have found. Of equal cosines the example that is first in the
        index is taken; missing ones are -1.
        """
        ids, sims = np.full((n, k), -1), np.zeros((n, k))
        bound = np.add.reduceat(self.top[t] * w[:, None], np.searchsorted(d, np.arange(n))) if n else np.zeros((0, self.n_blocks))
        for b in range(self.n_blocks):
            open_ = bound[:, b] > sims[:, -1] + 1e-12
            at = np.flatnonzero(open_[d])
            terms, rows = self.part(b)
            if not len(at) or not len(terms):
                continue
            place = np.minimum(np.searchsorted(terms, t[at]), len(terms) - 1)
            hit = terms[place] == t[at]
            at, place = at[hit], place[hit]
            first = np.flatnonzero(np.diff(d[at], prepend=-1))
            who = d[at[first]]
            cosines = np.add.reduceat(rows[place] * w[at][:, None], first)
            better = cosines.max(1) > sims[who, -1] + 1e-12
            who, cosines = who[better], cosines[better]
            both = np.concatenate((sims[who], np.where(cosines > sims[who, -1:] + 1e-12, cosines, 0)), axis=1)
            best = np.argsort(-both.round(12), axis=1, kind="stable")[:, :k]
            names = np.concatenate((ids[who], np.broadcast_to(np.arange(self.block) + b * self.block, (len(who), self.block))), axis=1)
            sims[who] = np.take_along_axis(both, best, 1)
            ids[who] = np.where(sims[who] > 0, np.take_along_axis(names, best, 1), -1)
        return ids, sims

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one vector, without what is missing."""
        ids, sims = self.nearest_all(np.zeros(len(t), np.int64), t, w, 1, k) if len(t) else (np.full((1, k), -1), np.zeros((1, k)))
        return ids[0][ids[0] >= 0], sims[0][ids[0] >= 0]


def unit(d: np.ndarray, n: np.ndarray, t: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    w = (1 + np.log(n)) * weight[t] if len(t) else np.zeros(0)
    norm = np.sqrt(np.bincount(d, w * w, minlength=n_docs)) if len(d) else np.ones(n_docs)
    return w / norm[d] if len(d) else w


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> dict:
    """Vocabulary, weights, index, labels and the scores of texts without vocabulary. Bounded by the parameters."""
    learnt = docs.sparkSession

    def hashed(batches):
        for b in tk.slices(batches):
            h, d = terms(*tk.pack(b.column("text")))
            p = np.unique(np.rec.fromarrays([d, h], names="d,h"))
            cut = np.searchsorted(p["d"], np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(p["h"].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), lists], ["doc_id", "label", "h"])

    sample = labelled_sample(docs, labels, "toxic", 4, 2, max_train)
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").repartition(max(1, int(learnt.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(hashed, "doc_id long, label int, h array<long>")
    # examples with the same words are one, so that a text with many copies doesn't make its words look telling
    rows = rows.groupBy(F.xxhash64("h").alias("mark"), F.size("h").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"), F.min_by("h", "doc_id").alias("h"))
    split = rows.select("doc_id", "label", F.explode("h").alias("h"))
    y_all = rows.select("doc_id", "label").toPandas().sort_values("doc_id").reset_index(drop=True)
    n, p = len(y_all), float(y_all.label.mean()) if len(y_all) else 0.0
    vocabulary = np.zeros(0, tk.U64)
    if n and 0 < p < 1:
        by_word = split.groupBy("h").agg(F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")).where(F.col("a") > F.col("n") * p)
        ranked = by_word.select("h", likelihood_ratio(F.col("a"), F.col("n"), float(y_all.label.sum()), n).alias("llr")).where(F.col("llr") >= LEAST_LLR)
        best = ranked.orderBy(F.desc("llr"), "h").limit(max_terms).toPandas()  # MAX_TERMS bounds what is broadcast
        vocabulary = np.sort(best.h.to_numpy(np.int64).view(tk.U64))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches):
        for b in tk.slices(batches):
            d, t, c = counts(*tk.pack(b.column("text")), shared.value)
            if len(d):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(t.astype(np.int32)), pa.array(c.astype(np.int32))], ["doc_id", "t", "n"])

    def frequencies(batches):
        total = np.zeros(len(shared.value) + 1, np.int64)
        for b in tk.slices(batches):
            _, t, _ = counts(*tk.pack(b.column("text")), shared.value)
            total[:-1] += np.bincount(t, minlength=len(total) - 1)[: len(total) - 1]
            total[-1] += b.num_rows
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["t", "n"])

    df = np.zeros(len(vocabulary) + 1)
    for r in docs.select("text").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r["t"]] = r["n"]
    weight = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    v = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(vectors, "doc_id long, t int, n int").toPandas()
    v = v[v.doc_id.isin(y_all.doc_id)]
    at = y_all.doc_id.searchsorted(v.doc_id.to_numpy()) if len(v) else np.zeros(0, np.int64)
    order = np.lexsort((v.t.to_numpy(), at))
    d, t, c = at[order].astype(np.int64), v.t.to_numpy()[order].astype(np.int64), v.n.to_numpy()[order]
    y, ids = y_all.label.to_numpy(float), y_all.doc_id.to_numpy()
    bare = np.ones(n, bool)
    bare[d] = False
    rest = (y[bare].sum() + p) / (bare.sum() + 1) if n else 0.0
    w = unit(d, c, t, weight, n)
    # examples with the same heaviest term go side by side, so that blocks differ in their bounds; those without vocabulary leave the index
    heavy = np.full(n, len(vocabulary))
    by_weight = np.argsort(w, kind="stable")
    heavy[d[by_weight]] = t[by_weight]
    kept = np.lexsort((ids, heavy))[: int((~bare).sum())]
    place = np.zeros(n, np.int64)
    place[kept] = np.arange(len(kept))
    return {"vocabulary": vocabulary, "weight": weight, "index": BlockMaxIndex(place[d], t, w, len(kept), len(vocabulary), BLOCK), "y": y[kept], "id": ids[kept], "prior": p, "rest": float(rest)}


def likelihood_ratio(a: Column, n: Column, n1: float, total: int) -> Column:
    """Dunning's ratio of a two-way table: documents with the word and the label, with the word, with the label, in all."""
    p = n1 / total
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    return 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(n1 - a, (total - n) * p) + part(total - n1 - n + a, (total - n) * (1 - p)))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels, max_train)))

    def score(batches):
        m, seen = pickle.loads(shared.value), {}
        for b in tk.slices(batches):
            d, t, c = counts(*tk.pack(b.column("text")), m["vocabulary"])
            w = unit(d, c, t, m["weight"], b.num_rows)
            s, evidence = np.full(b.num_rows, m["rest"]), [[]] * b.num_rows
            which, at = np.unique(d, return_index=True)
            ends = [*at[1:], len(d)]
            keys = [t[lo:hi].tobytes() + c[lo:hi].tobytes() for lo, hi in zip(at, ends)]  # texts with equal vectors are looked up once
            if len(seen) > 100_000:
                seen.clear()
            new: dict[bytes, int] = {}
            for i, x in enumerate(keys):
                if x not in seen:
                    new.setdefault(x, i)
            rows = np.array(list(new.values()), np.int64)
            if len(rows):
                flat = np.concatenate([np.arange(at[i], ends[i]) for i in rows])
                ids, sims = m["index"].nearest_all(np.repeat(np.arange(len(rows)), [ends[i] - at[i] for i in rows]), t[flat], w[flat], len(rows), k)
                votes = ((sims * np.where(ids >= 0, m["y"][ids], 0)).sum(1) + 0.5 * m["prior"]) / (sims.sum(1) + 0.5)
                for x, v, near in zip(new, votes.tolist(), ids):
                    seen[x] = v, m["id"][near[near >= 0]].tolist()
            for i, x in zip(which, keys):
                s[i], evidence[i] = seen[x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
