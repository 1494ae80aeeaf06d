"""Suffix-array dedup: removing passages that also occur earlier in the corpus.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller
doc_id, or earlier in the same document. Strings never cross documents and are judged on
the input.

The suffix array is sparse. Each window of `length` bytes has an anchor, the position of its
least hashed GRAM-byte string, so equal windows have equal anchors; windows that share an
anchor form a *span*, and only span starts are sorted. Inside a block the spans' suffixes are
sorted deep-shallow: multikey quicksort on eight-byte words to SHALLOW bytes, then blind
tries for the groups that are still equal. Equal spans of different blocks meet by their
fingerprints in a bucketed exchange, which tells each block which of its spans occur earlier
elsewhere, and which anchors have several different spans. Only of the latter, first spans,
single windows are compared in a second exchange: there a repeated passage begins or ends.
Windows are hashed in pieces of PIECE, so the memory of a block doesn't grow with more than its
bytes and their hashes; a span that a piece's end cuts is two spans, and their windows meet singly.

Rows: a null text is empty, a null doc_id comes after all others; repeated rows of a doc_id
follow each other in the order of their texts. Texts shorter than `length` stay whole.
Inside a block the spans' bytes are compared. Between blocks, spans are equal by 128 bits (their
anchor's hash and their own), windows by 96 (their hash and 32 bits of their anchor's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillspark.llm import textkernel as tk
from quillspark.llm.exchange import MESSAGE, MESSAGE_SQL, KEYS_PER_BUCKET, answers, in_order, into_blocks, receive, reply, send
from quillspark.llm.shared import table, text_bytes

LENGTH, GRAM, SHALLOW, PIECE = 100, 32, 32, 1 << 18
_LAST = np.iinfo(np.int64).max


def rolling(buf: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all strings of each size (sums of powers of two), at their starts."""
    n = len(buf)
    level, width, by_bit = tk.BYTE[buf], 1, {}
    power = tk.BASE
    while width <= max(sizes):
        if any(width & size for size in sizes):
            by_bit[width] = level
        level = level[:-width] * power + level[width:] if len(level) > width else np.zeros(0, tk.U64)
        power, width = power * power, width * 2
    out = []
    for size in sizes:
        if n < size:
            out.append(np.zeros(0, tk.U64))
            continue
        total, at = np.zeros(n - size + 1, tk.U64), 0
        for bit in sorted((b for b in by_bit if b & size), reverse=True):
            total = total * tk.U64(pow(int(tk.BASE), bit, 1 << 64)) + by_bit[bit][at : at + n - size + 1]
            at += bit
        out.append(total)
    return out


def spans(buf: np.ndarray, off: np.ndarray, length: int, gram: int, piece: int | None = None) -> dict[str, np.ndarray]:
    """Spans of a pack: first and last window start, document, anchor hash, span fingerprint; and the hashes of all windows."""
    piece = piece or PIECE
    window = np.zeros(max(0, len(buf) - length + 1), tk.U64)
    parts = [_spans_between(buf, off, length, gram, lo, min(lo + piece, len(window)), window) for lo in range(0, len(window), piece)]
    empty = {k: np.zeros(0, np.int64) for k in ("lo", "hi", "doc")} | {k: np.zeros(0, tk.U64) for k in ("anchor", "span")}
    return {k: np.concatenate([p[k] for p in parts]) if parts else e for k, e in empty.items()} | {"window": window}


def _spans_between(buf: np.ndarray, off: np.ndarray, length: int, gram: int, a: int, b: int, window: np.ndarray) -> dict[str, np.ndarray]:
    """The spans of the windows that start in [a, b), whose hashes go to `window`."""
    g, w = rolling(buf[a : b + length - 1], (gram, length))
    window[a:b] = w
    key = (tk.mix(g) & ~tk.U64(0xFFFFFFF)) | np.arange(len(g), dtype=tk.U64)  # the leftmost of equal hashes; a piece has less than 2^28 bytes
    reach, width, least = length - gram + 1, 1, key
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = reach - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    least = (least[: len(w)] & tk.U64(0xFFFFFFF)).astype(np.int64)
    first_doc, last_doc = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b - 1, "right")
    lo_of, n_in = np.maximum(off[first_doc:last_doc], a), np.minimum(off[first_doc + 1 : last_doc + 1] - length + 1, b)
    n_in = np.maximum(n_in - lo_of, 0)
    doc_of = np.repeat(np.arange(first_doc, last_doc), n_in)
    start = np.repeat(lo_of - a - np.concatenate(([0], np.cumsum(n_in)[:-1])), n_in) + np.arange(n_in.sum())
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc_of[1:] != doc_of[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1 if len(first) else first
    lo, hi, m = start[first], start[last], anchor[first]
    c = tk.salted(31, 4)
    print_ = tk.mix(tk.mix(w[lo] * c[0] + w[hi] * c[1]) + (hi - lo).astype(tk.U64) * c[2] + (m - lo).astype(tk.U64) * c[3])
    return {"lo": lo + a, "hi": hi + a, "doc": doc_of[first], "anchor": tk.mix(g[m]), "span": print_}


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes keep only where their strings part, and by which byte."""

    def __init__(self, text: bytes):
        self.text, self.root = text, None

    def add(self, lo: int, hi: int, name: int) -> None:
        """A string text[lo:hi]; equal strings share a leaf."""
        if self.root is None:
            self.root = [None, (lo, hi), [name]]
            return
        node = self.root
        while node[0] is not None:  # blind: only the bytes at which strings part are looked at
            at = lo + node[0]
            key = self.text[at] if at < hi else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        a, b = self.text[lo:hi], self.text[node[1][0] : node[1][1]]
        if a == b:
            node[2].append(name)
            return
        n = min(len(a), len(b))
        split = next((i for i in range(0, n, 16) if a[i : i + 16] != b[i : i + 16]), n)
        while split < n and a[split] == b[split]:
            split += 1
        split = min(split, n)
        mine, theirs = (x[split] if split < len(x) else -1 for x in (a, b))
        parent, node = None, self.root
        while node[0] is not None and node[0] < split:
            parent, node = node, node[1][a[node[0]]]
        leaf = [None, (lo, hi), [name]]
        if node[0] == split:
            node[1][mine] = leaf
            return
        inner = [split, {mine: leaf, theirs: node}, None]
        if parent is None:
            self.root = inner
        else:
            parent[1][a[parent[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Names of equal strings, in the order of the strings."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                out.append(node[2])
            else:
                todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
        return out


def deep_shallow(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each in that order): strings buf[lo:hi], each of at least `shallow` bytes, sorted; equal ones share a class."""
    n = len(lo)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that aren't alone in their group
    for depth in range(0, shallow, 8):
        at = lo[order[open_]] + depth
        word = np.zeros(len(open_), tk.U64)
        for k in range(8):
            word = (word << tk.U64(8)) | buf[at + k].astype(tk.U64)
        by = np.lexsort((word, group[open_]))
        order[open_], word, g = order[open_[by]], word[by], group[open_]
        change = np.ones(len(open_), bool)
        change[1:] = (word[1:] != word[:-1]) | (g[1:] != g[:-1])
        head = np.flatnonzero(change)
        group[open_] = open_[head][np.cumsum(change) - 1]  # a group is named by its first place
        alone = change.copy()
        alone[:-1] &= change[1:]
        open_ = open_[~alone]
        if not len(open_):
            break
    if len(open_):
        text = buf.tobytes()
        cut = np.flatnonzero(np.diff(group[open_], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(open_)]):
            trie, places = BlindTrie(text), open_[a:b]
            for x in np.sort(order[places]):
                trie.add(int(lo[x]), int(hi[x]), int(x))
            at = int(places[0])
            for leaf in trie.leaves():
                order[at : at + len(leaf)] = leaf
                group[at : at + len(leaf)] = at
                at += len(leaf)
    return order, group


def _block(rows: pa.Table, length: int, gram: int) -> dict:
    """A block's spans, sorted: which are the first of their class in the block, and the classes' fingerprints."""
    rows = in_order(rows.drop_columns(["body"]).append_column("text", pa.array(unpress(rows.column("body").to_pylist()), pa.large_string())))
    buf, off = tk.pack(rows.column("text"))
    rows = rows.drop_columns(["text"])
    s = spans(buf, off, length, gram)
    order, group = deep_shallow(buf, s["lo"], s["hi"] + length, min(SHALLOW, length // 8 * 8))
    n = len(order)
    first = np.full(n, _LAST)
    np.minimum.at(first, group, order)  # rows are in document order, so the least number is the first occurrence
    of = np.empty(n, np.int64)
    of[order] = first[group]
    ids = pc.fill_null(rows.column("doc_id"), int(_LAST)).to_numpy()
    heads = np.flatnonzero(of == np.arange(n))
    key = s["anchor"][heads]
    by = np.lexsort((s["span"][heads], key))
    return s | {"rows": rows, "buf": buf, "off": off, "of": of, "heads": heads[by], "ids": ids}


def _distinct_anchor_messages(s: dict, block: int, n_buckets: int) -> list[dict]:
    h = s["heads"]
    return send(block, 1, n_buckets, s["anchor"][h], s["span"][h], s["ids"][s["doc"][h]])


def unpress(bodies: list) -> list:
    d = zstandard.ZstdDecompressor()
    return [None if z is None else d.decompress(z).decode() for z in bodies]


def _first_of(key: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Whether each row's document is later than another row's of an equal key."""
    order = np.lexsort((doc, *key))
    same = np.ones(len(order), bool)
    if len(order):
        same[0] = False
        for k in key:
            same[1:] &= k[order][1:] == k[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[order][head]
    return later


def _pressed(blocks: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The blocks with their texts compressed: block, doc_id, keep..., body."""
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keep).schema.fields) if keep else ""

    def press(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            bodies = pa.array([None if t is None else c.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("doc_id"), *[b.column(k) for k in keep], bodies], ["block", "doc_id", *keep, "body"])

    return blocks.mapInArrow(press, "block int, doc_id long" + carried + ", body binary")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, *keep: str, as_text: bool = False) -> DataFrame:
    """docs(doc_id, text, keep...) -> doc_id, keep..., n_bytes, spans (array of removed [start, end)), kept (the remaining bytes).

    as_text: kept is a string instead, without characters of which only some bytes remain.
    """
    total = text_bytes(docs)
    blocks = _pressed(into_blocks(docs, total, *keep), keep)
    n_buckets = max(1, total // 30 // KEYS_PER_BUCKET)

    def ask(key, rows):
        block = key[0].as_py()
        return pa.Table.from_pylist(_distinct_anchor_messages(_block(rows, length, gram), block, n_buckets), MESSAGE)

    def tell(key, rows):
        sender, anchor, (span, doc) = receive(rows, n_buckets)
        order = np.lexsort((span, anchor))
        a, s = anchor[order], span[order]
        new_anchor = np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        at = np.cumsum(new_anchor) - 1
        several = np.zeros(int(at[-1]) + 1 if len(at) else 0, bool)
        several[at[1:][~new_anchor[1:] & (s[1:] != s[:-1])]] = True
        mixed = np.zeros(len(a), bool)
        mixed[order] = several[at]
        return reply(rows, sender, 1, (_first_of((span, anchor), doc) + 2 * mixed).astype(np.uint8))

    def windows(s: dict, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of first spans with a mixed anchor: distinct windows by hash and anchor's hash, all their places, and which window each place has."""
        own = np.zeros(len(s["lo"]), np.uint8)
        own[s["heads"]] = flags
        open_ = np.flatnonzero((s["of"] == np.arange(len(own))) & (own == 2))
        n = s["hi"][open_] - s["lo"][open_] + 1
        place = np.repeat(s["lo"][open_] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(open_) else np.zeros(0, np.int64)
        key, check = tk.mix(s["window"][place]), (np.repeat(s["anchor"][open_], n) >> tk.U64(32)).astype(np.uint32)
        order = np.lexsort((check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return key[order][new], check[order][new], place, inverse

    def ask_windows(key, rows, told):
        s = _block(rows, length, gram)
        (flags,) = answers(told, 1, s["anchor"][s["heads"]], n_buckets, [np.uint8])
        key_, check, place, inverse = windows(s, flags)
        first = np.full(len(key_), _LAST)
        np.minimum.at(first, inverse, place)
        doc = s["ids"][np.searchsorted(s["off"], first, "right") - 1] if len(first) else np.zeros(0, np.int64)
        return pa.Table.from_pylist(send(key[0].as_py(), 2, n_buckets, key_, check, doc), MESSAGE)

    def tell_windows(key, rows):
        sender, window, (check, doc) = receive(rows, n_buckets)
        return reply(rows, sender, 2, _first_of((check, window), doc).astype(np.uint8))

    carried = [f for f in docs.select(*keep).schema.fields] if keep else []

    def remove(key, rows, told):
        if not rows.num_rows:
            return out_schema.empty_table()
        s = _block(rows, length, gram)
        buf, off, of = s["buf"], s["off"], s["of"]
        (flags,) = answers(told, 1, s["anchor"][s["heads"]], n_buckets, [np.uint8])
        key_, _, place, inverse = windows(s, flags)
        (earlier,) = answers(told, 2, key_, n_buckets, [np.uint8])
        first = np.full(len(key_), _LAST)
        np.minimum.at(first, inverse, place)
        gone = place[(earlier[inverse] == 1) | (place > first[inverse])]
        own = np.zeros(len(of), np.uint8)
        own[s["heads"]] = flags
        whole = (of != np.arange(len(of))) | ((own[of] & 1) == 1)
        step = np.zeros(len(buf) + 1, np.int32)
        np.add.at(step, s["lo"][whole], 1)
        np.add.at(step, s["hi"][whole] + length, -1)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + length, -1)
        hit = np.cumsum(step[:-1]) > 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        begins, ends = hit.copy(), hit.copy()
        if len(buf):
            begins[1:] &= ~hit[:-1] | edge[1:-1]
            ends[:-1] &= ~hit[1:] | edge[1:-1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        cut = np.searchsorted(b, off)
        doc = np.searchsorted(off, b, "right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(b - off[doc]), pa.array(e - off[doc])], ["start", "end"])
        kept_off = np.concatenate(([0], np.cumsum(~hit)))[off]
        kept = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(kept_off.astype(np.int64).tobytes()), pa.py_buffer(buf[~hit].tobytes())]).cast(pa.binary())
        if as_text:
            kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
        cols = [s["rows"].column("doc_id"), *[s["rows"].column(k) for k in keep], pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs), kept]
        return pa.table(cols, names=["doc_id", *keep, "n_bytes", "spans", "kept"])

    out_sql = ", ".join(["doc_id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in carried], "n_bytes long", "spans array<struct<start:long,end:long>>", "kept string" if as_text else "kept binary"])
    out_schema = to_arrow_schema(_parse_datatype_string(out_sql))
    told = blocks.groupBy("block").applyInArrow(ask, MESSAGE_SQL).groupBy("bucket").applyInArrow(tell, MESSAGE_SQL)
    by_window = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_windows, MESSAGE_SQL).groupBy("bucket").applyInArrow(tell_windows, MESSAGE_SQL)
    return blocks.groupBy("block").cogroup(told.unionByName(by_window).groupBy("block")).applyInArrow(remove, out_sql)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
