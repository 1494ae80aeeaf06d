"""Vectorised text primitives shared by the corpus operators.

A *pack* is a run of whole texts laid end to end as UTF-8 (`buf`, `off`), so
that words, lines and hashes of thousands of documents come from a handful of
numpy passes instead of a Python loop per word. Null texts count as empty.
All hashes are fixed functions of the bytes: every executor gets the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * _MUL)


BYTE = salted(11, 256)
BASE = U64(0xD6E8FEB86659FD93)
_STEPS = 48


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pack(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text: a long text stays whole."""
    for batch in batches:
        size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of bytes that are no white space."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A hash of each of the disjoint byte spans: a polynomial in BASE over the table's numbers of its bytes, and its length.

    Spans are worked on by falling length, one byte of all at a time; what is left of the few
    that are longer than _STEPS is summed up at once.
    """
    length = end - start
    order = np.argsort(np.minimum(-length, 0).clip(-_STEPS), kind="stable")
    at, short = start[order], np.minimum(length[order], _STEPS)
    many = np.searchsorted(-short, -np.arange(short[0] if len(short) else 0), "left")  # spans with more than k bytes
    h = np.zeros(len(start), U64)
    for k, n in enumerate(many):
        h[:n] = h[:n] * BASE + table[buf[at[:n] + k]]
    out = np.empty(len(start), U64)
    out[order] = h
    long = np.flatnonzero(length > _STEPS)
    if len(long):
        rest = length[long] - _STEPS
        power = powers(int(rest.max()) + 1)
        first = np.concatenate(([0], np.cumsum(rest)[:-1]))
        pos = np.arange(int(rest.sum())) - np.repeat(first, rest)
        bytes_ = buf[pos + np.repeat(start[long] + _STEPS, rest)]
        out[long] = out[long] * power[rest] + np.add.reduceat(table[bytes_] * power[np.repeat(rest, rest) - 1 - pos], first)
    return mix(out + length.astype(U64) * _MUL)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the pieces that a split at line feeds gives."""
    feed = np.flatnonzero(buf == 10)
    n_docs = len(off) - 1
    doc = np.searchsorted(off, feed, "right") - 1
    start = np.concatenate((off[:-1], feed + 1))
    end = np.concatenate((feed, off[1:]))
    sdoc = np.concatenate((np.arange(n_docs), doc))
    edoc = np.concatenate((doc, np.arange(n_docs)))
    a, b = np.lexsort((start, sdoc)), np.lexsort((end, edoc))
    return start[a], end[b], sdoc[a]


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words that follow each other in one document, and where they start."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    factor = salted(23, n)
    out = np.zeros(len(at), U64)
    for k in range(n):
        out += hashes[at + k] * factor[k]
    return mix(out), at


def counts_by_doc(doc: np.ndarray, bins: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bin) pairs, in that order, and how often each occurs."""
    key, n = np.unique(doc.astype(np.int64) * n_bins + bins.astype(np.int64), return_counts=True)
    return key // n_bins, key % n_bins, n


def column_or(table, name: str, default):
    return table.column(name) if name in table.schema.names else default
