"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of long documents.

The model file is a parameter; its pieces and scores are used as they are. For a BPE model a
sequence of pieces is the encoding exactly if each two neighbours, put together, are encoded
as just these two. So encoding is a best path through a lattice whose states are the last
piece and where it ends, with weight 0 for such neighbours and minus infinity for others.

A long document is cut into chunks of CHUNK code points, wherever that falls. The states at a
cut are the pieces that could start before it and reach it or span it. Each chunk yields a
max-plus transfer matrix from the states at its start to those at its end; matrices multiply
associatively (`scan` combines them in a tree), which gives the state at every cut, and each
chunk is then backtraced on its own from its two states. Inside a chunk, between the first and
the last place where a space follows a character that isn't one, no piece can cross, all paths
agree, and the library encodes that part.

A document of one chunk has no cut, and the library encodes it. Up to GIANT code points the
chunks of a document are encoded, combined and backtraced in one task. Longer ones are dealt out
by chunk, so that one document's chunks are encoded by many tasks; only their states' numbers
and matrices meet by document.

A null or empty text has no ids. Decoding gives the text back exactly, except that U+2581
(the model's own mark for a space) comes back as a space. Repeated rows are encoded each.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textkernel as tk
from quillspark.llm.shared import n_parts, table, written

CHUNK, MARK = 16_384, "▁"
GIANT = 4 * CHUNK
NEVER = -np.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in kept}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._together: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string: the neighbours with the best scored union are merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], NEVER), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def together(self, a: str, b: str) -> bool:
        """Whether piece b can follow piece a."""
        if b[0] == MARK != a[-1]:
            return True
        key = (a, b)
        if key not in self._together:
            if len(self._together) > 500_000:
                self._together.clear()
            self._together[key] = self.merge(a + b) == [a, b]
        return self._together[key]

    def number(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.byte[b] for b in p.encode())
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that could be the last to start before a cut, relative to it."""
        out = []
        for a in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), a + self.longest) + 1):
                if text[a:e] in self.ids or (e == a + 1 == cut):
                    out.append((a - cut, e - cut))
        return out

    def paths(self, text: str, at: int, last: str | None, stop: int) -> dict[tuple[int, int], list[str]]:
        """All valid paths from a place (after piece `last`) to pieces that start before `stop` and reach it: by (start, end), the pieces."""
        open_: dict[int, dict[str | None, tuple]] = {at: {last: (None, None)}}
        done: dict[tuple[int, int], list[str]] = {}
        for i in range(at, stop):
            here = open_.pop(i, None)
            if not here:
                continue
            for e in range(i + 1, min(len(text), i + self.longest) + 1):
                piece = text[i:e]
                if e > i + 1 and piece not in self.ids:
                    continue
                for before, trail in here.items():
                    if before is None or self.together(before, piece):
                        mine = (piece, trail)
                        if e < stop:
                            open_.setdefault(e, {}).setdefault(piece, mine)
                        else:
                            pieces, t = [], mine
                            while t[0] is not None:
                                pieces.append(t[0])
                                t = t[1]
                            done.setdefault((i, e), pieces[::-1])
        return done

    def chunk(self, text: str, lo: int, hi: int) -> dict:
        """A chunk's transfer matrix and what backtracing needs. text: the chunk text[lo:hi] with its surroundings."""
        entries = self.states(text, lo) if lo else [(0, 0)]
        exits = self.states(text, hi) if hi < len(text) else [s for s in self.states(text, hi) if s[1] == 0]
        first = next((i for i in range(lo + self.longest if lo else lo, hi) if text[i] == MARK and (i == 0 or text[i - 1] != MARK)), None)
        matrix = np.full((len(entries), len(exits)), NEVER)
        if first is None:  # no place where all paths meet
            ways = {}
            for x, (a, e) in enumerate(entries):
                found = self.paths(text, lo + e, text[lo + a : lo + e] if lo else None, hi)
                if lo + e >= hi:  # the entering piece spans the whole chunk
                    found = {(lo + a, lo + e): []}
                for y, (b, f) in enumerate(exits):
                    if (hi + b, hi + f) in found:
                        matrix[x, y] = 0.0
                        ways[x, y] = found[hi + b, hi + f]
            return {"matrix": matrix, "ways": ways}
        final = next(i for i in range(hi - 1, first - 1, -1) if text[i] == MARK and (i == 0 or text[i - 1] != MARK))
        heads, tails = {}, {}
        for x, (a, e) in enumerate(entries):
            if lo == 0 and first == 0:
                heads[x] = []
            else:
                found = [v for (_, end), v in self.paths(text, lo + e, text[lo + a : lo + e] if lo else None, first).items() if end == first] if lo + e < first else []
                if found or lo + e == first:
                    heads[x] = found[0] if found else []
        found = self.paths(text, final, None, hi)
        for y, (b, f) in enumerate(exits):
            if (hi + b, hi + f) in found:
                tails[y] = found[hi + b, hi + f]
        for x in heads:
            for y in tails:
                matrix[x, y] = 0.0
        middle = self.sp.encode(text[first + 1 : final].replace(MARK, " ")) if final > first else []
        return {"matrix": matrix, "heads": heads, "tails": tails, "middle": middle}

    def backtrace(self, chunk: dict, x: int, y: int) -> list[int]:
        if "ways" in chunk:
            return self.number(chunk["ways"][x, y])
        return [*self.number(chunk["heads"][x]), *chunk["middle"], *self.number(chunk["tails"][y])]

    def encode(self, text: str, size: int = CHUNK) -> list[int]:
        """One document, chunk by chunk."""
        marked = MARK + text.replace(" ", MARK)
        if not text or len(marked) <= size:
            return self.sp.encode(text) if text else []
        side = 2 * self.longest
        chunks = []
        for lo in range(0, len(marked), size):
            a, b = max(0, lo - side), min(len(marked), lo + size + side)
            chunks.append(self.chunk(marked[a:b] if b < len(marked) else marked[a:], lo - a, min(lo + size, len(marked)) - a))
        states = at_cuts([c["matrix"] for c in chunks])
        return [i for c, x, y in zip(chunks, states, states[1:]) for i in self.backtrace(c, x, y)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves: the product of a half is shared by all that follow it."""
    if len(matrices) == 1:
        return matrices
    half = len(matrices) // 2
    left, right = scan(matrices[:half]), scan(matrices[half:])
    return left + [product(left[-1], r) for r in right]


def at_cuts(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut, of the best path from the first state to the best last one."""
    prefix = scan(matrices)
    states = [int(prefix[-1][0].argmax())]
    if prefix[-1][0, states[0]] == NEVER:
        raise ValueError("the pieces don't cover the text")
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int((prefix[k - 1][0] + matrices[k][:, states[-1]]).argmax()) if k else 0)
    return states[::-1]


@functools.lru_cache(2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str | None = None, size: int = CHUNK, giant: int = GIANT, keep: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """docs(doc_id, text, keep...) -> doc_id, text, keep..., ids (array of int); with verify also round_trip: whether they decode to the text."""
    model = model_file or default_model()
    rows = docs.select("doc_id", "text", *keep)
    long = F.coalesce(F.char_length("text"), F.lit(0)) > giant

    def whole(batches):
        c = codec(model)
        for b in tk.slices(batches, limit=1 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) < size]
            ids = dict(zip(short, c.sp.encode([texts[i] for i in short], num_threads=1)))
            out = [ids[i] if i in ids else c.encode(t, size) for i, t in enumerate(texts)]
            back = [pa.array([c.sp.decode(i) == t for i, t in zip(out, texts)], pa.bool_())] if verify else []
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in b.schema.names], pa.array(out, pa.list_(pa.int32())), *back], [*b.schema.names, "ids", *["round_trip"] * verify])

    order = ["doc_id", "text", *keep]
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    short = rows.where(~long).mapInArrow(whole, f"{sql}, ids array<int>" + ", round_trip boolean" * verify)
    giants = written(rows.where(long).withColumn("_row", F.expr("uuid()")))  # written, so that a row keeps its name

    def cut(batches):
        side, press = 2 * codec(model).longest, zstandard.ZstdCompressor(level=1)
        for b in batches:
            for row, text in zip(b.column("_row").to_pylist(), b.column("text").to_pylist()):
                marked = MARK + text.replace(" ", MARK)
                for k, lo in enumerate(range(0, len(marked), size)):
                    a, hi = max(0, lo - side), min(len(marked), lo + size)
                    end = min(len(marked), hi + side)
                    yield pa.RecordBatch.from_pydict({"_row": [row], "k": pa.array([k], pa.int32()), "part": [press.compress(marked[a:end].encode())], "lo": pa.array([lo - a], pa.int32()), "hi": pa.array([hi - a], pa.int32())})

    def transfer(batches):
        c, d = codec(model), zstandard.ZstdDecompressor()
        for b in batches:
            m = [c.chunk(d.decompress(t).decode(), lo, hi)["matrix"] for t, lo, hi in zip(*(b.column(n).to_pylist() for n in ("part", "lo", "hi")))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array([x.shape[0] for x in m], pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in m])], ["_row", "k", "n", "matrix"])

    def combine(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        m = [np.frombuffer(x, np.float32).reshape(n, -1) for x, n in zip(rows.column("matrix").to_pylist(), rows.column("n").to_pylist())]
        s = at_cuts(m)
        return pa.table([rows.column("_row"), rows.column("k"), pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())], ["_row", "k", "x", "y"])

    def trace(batches):
        c, d = codec(model), zstandard.ZstdDecompressor()
        for b in batches:
            ids = [c.backtrace(c.chunk(d.decompress(t).decode(), lo, hi), x, y) for t, lo, hi, x, y in zip(*(b.column(n).to_pylist() for n in ("part", "lo", "hi", "x", "y")))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["_row", "k", "ids"])

    parts = giants.select("_row", "text").mapInArrow(cut, "_row string, k int, part binary, lo int, hi int").repartition(n_parts(docs.sparkSession), "_row", "k")
    states = parts.mapInArrow(transfer, "_row string, k int, n int, matrix binary").groupBy("_row").applyInArrow(combine, "_row string, k int, x int, y int")
    ids = parts.join(states, ["_row", "k"]).select("_row", "k", "part", "lo", "hi", "x", "y").mapInArrow(trace, "_row string, k int, ids array<int>")
    ids = ids.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).alias("ids"))
    long_ones = giants.join(ids, "_row").select(*order, "ids")
    if verify:
        long_ones = decode_documents(long_ones, model, "text", *keep).withColumn("round_trip", F.col("decoded") == F.col("text")).drop("decoded")
    return short.unionByName(long_ones)


def decode_documents(encoded: DataFrame, model_file: str | None = None, *keep: str) -> DataFrame:
    """encoded(doc_id, ids, keep...) -> doc_id, ids, keep..., decoded."""
    model = model_file or default_model()
    rows = encoded.select("doc_id", "ids", *keep)

    def decode(batches):
        c = codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.sp.decode(i) if i else "" for i in part.column("ids").to_pylist()], pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(decode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as decimal numbers, comma between), round_trip (decoding gives the text back)."""
    both = encode_documents(table(spark, sf_dir, "documents"), verify=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")
