"""Bucketed exchange of fingerprints between blocks of documents.

Questions like "does an earlier document hold this passage?" need one answer per distinct
fingerprint, not a row per occurrence. Documents are dealt into *blocks* of bounded size by
a hash of their id. Each block sends its distinct fingerprints, sorted and packed, to
*buckets* by fingerprint; a bucket merges what all blocks sent and answers each block in the
order of its request. A fingerprint that a third of all documents share is sent once a
block, so no bucket and no block grows with it, and nothing is capped or dropped.

All steps are plain grouped maps over shuffles: a lost executor's part is recomputed.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, KEYS_PER_BUCKET = 3 << 20, 200_000
MESSAGE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
MESSAGE_SQL = "block int, bucket int, kind int, body binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: by byte planes, so that what is zero in all numbers vanishes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        parts.append((a.dtype.str, len(a), zstandard.compress(planes, 1)))
    return pickle.dumps(parts)


def unsqueeze(body: bytes) -> list[np.ndarray]:
    out = []
    for dtype, n, z in pickle.loads(body):
        dtype = np.dtype(dtype)
        planes = np.frombuffer(zstandard.decompress(z) if n else b"", np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def into_blocks(docs: DataFrame, total_bytes: int, *keep: str) -> DataFrame:
    """(block, doc_id, text, keep...): blocks of about BLOCK_BYTES; rows without id are spread by their text."""
    n = max(1, -(-total_bytes // BLOCK_BYTES))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)


def in_order(rows: pa.Table) -> pa.Table:
    """A block's rows in an order that doesn't depend on how they arrived."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def send(block: int, kind: int, n_buckets: int, key: np.ndarray, *more: np.ndarray) -> list[dict]:
    """Messages with sorted distinct keys and what goes with each, by bucket. key: sorted, uint64."""
    bucket = (key % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    out = []
    for b in range(n_buckets):
        at = order[cut[b] : cut[b + 1]]
        if len(at):
            out.append({"block": block, "bucket": b, "kind": kind, "body": squeeze(deltas(key[at] // np.uint64(n_buckets)), *[m[at] for m in more])})
    return out


def receive(rows: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sender number, key, further arrays) of all messages in a bucket; rows are numbered as they come."""
    found = [unsqueeze(b) for b in rows.column("body").to_pylist()]
    bucket = rows.column("bucket").to_numpy()
    sender = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    key = np.concatenate([undelta(f[0]) * np.uint64(n_buckets) + np.uint64(b) for f, b in zip(found, bucket)])
    return sender, key, [np.concatenate(x) for x in zip(*[f[1:] for f in found])]


def reply(rows: pa.Table, sender: np.ndarray, kind: int, *values: np.ndarray) -> pa.Table:
    """The answers to a bucket's messages, each in the order of its keys."""
    cut = np.searchsorted(sender, np.arange(rows.num_rows + 1))
    out = [{"block": b, "bucket": k, "kind": kind, "body": squeeze(*[v[cut[i] : cut[i + 1]] for v in values])} for i, (b, k) in enumerate(zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist()))]
    return pa.Table.from_pylist(out, MESSAGE)


def answers(rows: pa.Table, kind: int, key: np.ndarray, n_buckets: int, dtypes: list) -> list[np.ndarray]:
    """What the buckets said of a block's sorted distinct keys, in their order."""
    out = [np.zeros(len(key), t) for t in dtypes]
    bucket = (key % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b, k, body in zip(rows.column("bucket").to_pylist(), rows.column("kind").to_pylist(), rows.column("body").to_pylist()):
        if k == kind:
            for o, v in zip(out, unsqueeze(body)):
                o[order[cut[b] : cut[b + 1]]] = v
    return out
