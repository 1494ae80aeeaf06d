"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs (lower case) and word shapes are hashed into N_BINS bins. Two
multinomials are counted: the raw one over every document, the target over every trusted
one (labels.quality = 1). No text is shuffled for that: a map pass turns each document into
its packed bins, and those meet the trusted ids by doc_id. A document's score is the mean of log(target/raw) over its
n-grams. It fails the method where that mean is below THRESHOLD: its n-grams are, on
average, that much rarer in trusted text than in the raw corpus.

Add-one smoothing keeps unseen bins finite. What reaches the
driver is 2 * N_BINS numbers. Base rules (word count, repeated words) come first.

A null or empty text has no words and fails the base rules. Without trusted rows the
ratio is 0 and only the base rules decide. Repeated rows are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.quality_classifier import _CLASS
from quillspark.llm.shared import one_label, table

N_BINS, THRESHOLD, MIN_WORDS, MAX_REPEAT_PERCENT = 8192, -0.7, 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def ngram_bins(buf: np.ndarray, start, end, doc) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams, and their documents."""
    word = tk.spans_hash(buf, start, end, tk.BYTE[tk.LOWER])
    kind = _CLASS[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    kept = np.flatnonzero(first)
    shape = tk.spans_hash(kind[kept], np.searchsorted(kept, start), np.searchsorted(kept, end))
    pair, at = tk.grams(word, doc, 2)
    shapes, to = tk.grams(shape, doc, 2)
    same = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    again = np.flatnonzero(same) + 1
    hashes = np.concatenate((word, pair, shape + tk.U64(1), shapes + tk.U64(2), np.full(len(again), 12345, tk.U64)))
    return (tk.mix(hashes) % tk.U64(N_BINS)).astype(np.int64), np.concatenate((doc, doc[at], doc, doc[to], doc[again]))


def base_counts(buf: np.ndarray, off: np.ndarray, start, end, doc) -> dict[str, np.ndarray]:
    """The contract's counts of each document of a pack."""
    n = len(off) - 1
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    n_words = np.bincount(doc, minlength=n)
    chars = np.concatenate(([0], np.cumsum(_LEAD[buf], dtype=np.int64)))
    word_chars = np.bincount(doc, chars[end] - chars[start], minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    a, b, line_doc = tk.lines(buf, off)
    solid = np.concatenate(([0], np.cumsum(~tk.SPACE[buf], dtype=np.int64)))
    worded = solid[b] > solid[a]
    a, b, line_doc = a[worded], b[worded], line_doc[worded]
    n_dup = np.zeros(n, np.int64)
    if len(a):
        h = tk.spans_hash(buf, a, b)
        order = np.lexsort((h, line_doc))
        again = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        n_dup = np.bincount(line_doc[order][1:][again], minlength=n)
    n_repeat = np.zeros(n, np.int64)
    word = tk.spans_hash(buf, start, end)
    tri, at = tk.grams(word, doc, 3)
    if len(tri):
        order = np.lexsort((tri, doc[at]))
        t, d = tri[order], doc[at][order]
        same = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(t), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(word), bool)
        where = at[order][twice]
        for k in range(3):
            hit[where + k] = True
        n_repeat = np.bincount(doc[hit], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": total(_SYMBOL[buf].astype(np.int64)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def pack_bins(bins: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Each document's bins, repeats too, as bytes: rises from bin to bin in order, a byte of 255 for each 255 and the rest."""
    key = np.sort(of * N_BINS + bins)
    doc, bin_ = key // N_BINS, key % N_BINS
    rise = np.diff(bin_, prepend=0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    rise[first] = bin_[first]
    last = np.cumsum(rise // 255 + 1)
    body = np.full(last[-1] if len(last) else 0, 255, np.uint8)
    body[last - 1] = rise % 255
    off = np.concatenate(([0], last))[np.searchsorted(doc, np.arange(n + 1))]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def unpack_bins(bodies: pa.Array) -> np.ndarray:
    """The bins of all bodies."""
    if not len(bodies):
        return np.zeros(0, np.int64)
    off = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, bodies.offset * 4).astype(np.int64)
    if off[-1] == off[0]:
        return np.zeros(0, np.int64)
    body = np.frombuffer(bodies.buffers()[2], np.uint8, off[-1] - off[0], off[0])
    off -= off[0]
    sum_ = np.cumsum(body, dtype=np.int64)
    ends = np.flatnonzero(body != 255)
    before = np.concatenate(([0], sum_))[off[:-1]]
    return sum_[ends] - np.repeat(before, np.diff(np.searchsorted(ends, off)))


def total(rows: DataFrame) -> np.ndarray:
    """Sums of n by bin."""
    out = np.zeros(N_BINS)
    for r in rows.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def _rows(counts: np.ndarray) -> list[pa.RecordBatch]:
    at = np.flatnonzero(counts)
    return [pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bin", "n"])] if len(at) else []


def bin_counts(docs: DataFrame) -> np.ndarray:
    """N-gram counts of all texts by bin."""

    def count(batches):
        sums = np.zeros(N_BINS, np.int64)
        for b in tk.slices(batches):
            buf, off = tk.pack(b.column("text"))
            start, end, doc = tk.words(buf, off)
            if len(start):
                sums += np.bincount(ngram_bins(buf, start, end, doc)[0], minlength=N_BINS)
        yield from _rows(sums)

    return total(docs.select("text").mapInArrow(count, "bin int, n long"))


def trusted_counts(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """N-gram counts by bin of the documents whose doc_id is in trusted."""

    def packed(batches):
        for b in tk.slices(batches):
            buf, off = tk.pack(b.column("text"))
            start, end, doc = tk.words(buf, off)
            if len(start):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pack_bins(*ngram_bins(buf, start, end, doc), b.num_rows)], ["doc_id", "bins"])

    def count(batches):
        sums = np.zeros(N_BINS, np.int64)
        for b in batches:
            sums += np.bincount(unpack_bins(b.column("bins")), minlength=N_BINS)
        yield from _rows(sums)

    bodies = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, "doc_id long, bins binary")
    # hashed by id at every size, and only the ids' side is held
    return total(bodies.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi").select("bins").mapInArrow(count, "bin int, n long"))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) of each bin."""
    trusted = one_label(labels, "quality").where("label = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    raw, target = bin_counts(docs), trusted_counts(docs, trusted)
    if not target.sum():
        return np.zeros(N_BINS)
    return np.log((target + 1) / (target.sum() + N_BINS)) - np.log((raw + 1) / (raw.sum() + N_BINS))


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the base counts, base_failed, score (the mean log ratio), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def judge(batches):
        for b in tk.slices(batches):
            buf, off = tk.pack(b.column("text"))
            start, end, doc = tk.words(buf, off)
            c = base_counts(buf, off, start, end, doc)
            score = np.zeros(b.num_rows)
            if len(start):
                bins, of = ngram_bins(buf, start, end, doc)
                n = np.bincount(of, minlength=b.num_rows)
                score = np.bincount(of, shared.value[bins], minlength=b.num_rows) / np.maximum(n, 1)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            kept = ~failed & (score >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in c.values()], pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *c, "base_failed", "score", "kept"])

    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, out)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
