"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

A document is its set of word shingles. Documents with equal sets form a class, of which
only one row goes on. Sizes fall into bands; for a pair the larger set's band counts,
so a set also appears in the bands above that a partner could be in. Within a band at most
d = (hi + hi) * (1 - t) / (1 + t) shingles may differ. The universe of shingles is hashed into
m = 3 (d + 1) / 2 segments; a linked pair agrees on m - d segments at least. Thus under any
common order of segments it shares one of the first d + 1 of each.

Cost-based allocation: that order is by how many sets have the same segment, counted over
all sets, so segments that many share (and empty ones) are the ones left out. Where d is 1,
segments would be tiny, and the whole set with its one-deletion neighbourhood is indexed instead.

The counts come from a bucketed exchange of segment fingerprints (see exchange.py), which
also names the first set with each segment. Links are then found as a search for components,
in three rounds: each set with the set it shares most segments with; each set with one set of
each of its segments; and last all sets of a segment that aren't in one component yet, in
tiles. Segments with the same sets are looked at once.

Before any text is fetched, a pair must pass its sizes and *parity maps*: a bit of the map is
how many of a set's shingles hash to it, modulo 2, so two maps differ in no more bits than the
sets differ in shingles, and none of the pairs that are dropped is a link. What passes is
verified exactly on the shingles of the whole texts. A tile verifies on its own and returns
a spanning forest of its links, so no pair of a large group is ever a row.

Null and empty texts, and texts without words, have no shingles and no links: their component
is their own id. Rows that repeat a doc_id are documents of their own, each with the component
of its own set. Rows without doc_id take part; a component without any doc_id is null.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exchange
from quillspark.llm import textkernel as tk
from quillspark.llm.components import components
from quillspark.llm.exchange import KEYS_PER_BUCKET, MESSAGE, MESSAGE_SQL, answers, receive, reply, send
from quillspark.llm.shared import heavy_keys, join_split, table, written

WORDS, PERCENT, RATIO, TILE = 5, 80, 1.5, 2048
PAIR_ROWS, BODY_ROWS = 200_000, 10_000  # rows of a task in the last round: with maps only, and with texts
_BITS = 52
_STEP = tk.salted(59, 1)[0]
_FEW = tk.salted(41, 64)
_SALT = tk.salted(53, 256)  # more bands than sizes of 64 bits can have


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles (64-bit hashes) of each document of a pack."""
    start, end, doc = tk.words(buf, off)
    word = tk.spans_hash(buf, start, end, tk.BYTE[tk.LOWER])
    gram, at = tk.grams(word, doc, n)
    n_docs = len(off) - 1
    n_words = np.bincount(doc, minlength=n_docs)
    cut = np.searchsorted(doc[at], np.arange(n_docs + 1))
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    out = []
    for i in range(n_docs):
        if n_words[i] >= n:
            out.append(np.unique(gram[cut[i] : cut[i + 1]]))
        elif n_words[i]:
            few = word[first[i] : first[i] + n_words[i]]
            out.append(tk.mix((few * _FEW[: len(few)]).sum(keepdims=True) + tk.U64(len(few))))
        else:
            out.append(np.zeros(0, tk.U64))
    return out


def band_of(size: int, ratio: float = RATIO) -> int:
    """The number of the band: each reaches from one more than the last one's end to `ratio` times its start."""
    b, lo, hi = 0, 1, 1
    while size > hi:
        b, lo = b + 1, hi + 1
        hi = max(lo, int(lo * ratio))
    return b


def band_ends(largest: int, ratio: float = RATIO) -> list[int]:
    out, lo = [], 1
    while not out or out[-1] < largest:
        out.append(max(lo, int(lo * ratio)))
        lo = out[-1] + 1
    return out


def bands_for(size: int, ends: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, most shingles that may differ there) of the bands in which a set of this size can have a larger partner."""
    b = int(np.searchsorted(ends, size))
    out = []
    most = size * 100 // percent
    while True:
        out.append((b, 2 * ends[b] * (100 - percent) // (100 + percent)))
        if ends[b] >= most or b + 1 >= len(ends):
            return out
        b += 1


def segment_keys(shingles: np.ndarray, owner: np.ndarray, band: int, differ: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Fingerprints of sets' filled segments in a band, by partition: keys, their sets, and how many of each set have to be indexed.

    shingles: of all sets, one after the other; owner: their sets, ascending. A set that fills
    too few segments (which the shared one might not be among) goes on to a further partition
    of the universe, as any partner with the same fate does.
    """
    salt = _SALT[band]
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    if differ == 0:
        return [(tk.mix(np.add.reduceat(shingles, at) + salt), owner[at], 1)]
    if differ == 1:  # the set and its one-deletion neighbourhood
        h = tk.mix(shingles)
        total, size = np.add.reduceat(h, at), np.diff(np.append(at, len(h)))
        return [(tk.mix(np.concatenate((total, np.repeat(total, size) - h)) + salt), np.concatenate((owner[at], owner)), int(size.max()) + 1)]
    m, out = 3 * (differ + 1) // 2, []
    while len(shingles):
        h = tk.mix(shingles ^ salt)
        place = owner * m + (h % tk.U64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        p = place[order]
        at = np.flatnonzero(np.diff(p, prepend=-1))
        sets = p[at] // m
        out.append((tk.mix(np.add.reduceat(tk.mix(h[order]), at) + (p[at] % m).astype(tk.U64) * _STEP + salt), sets, differ + 1))
        few = np.bincount(sets, minlength=int(owner[-1]) + 1)[owner] <= differ
        shingles, owner, salt = shingles[few], owner[few], tk.mix(np.array([salt]))[0]
    return out


def _keys(sets: list[np.ndarray], percent: int, ratio: float):
    """All keys of a block's sets: key, number of the set, number of the (set, partition), keys to index of each such; and the sets' sizes."""
    size = np.array([len(s) for s in sets], np.int64)
    ends = band_ends(int(size.max(initial=1)) * 100 // percent + 1, ratio)
    in_band: dict[tuple[int, int], list[int]] = {}
    for n in np.unique(size[size > 0]):
        for place in bands_for(int(n), ends, percent):
            in_band.setdefault(place, []).append(n)
    keys, owners, groups, need = [], [], [], []
    for (band, differ), sizes in sorted(in_band.items()):
        some = np.flatnonzero(np.isin(size, sizes))
        for k, owner, n in segment_keys(np.concatenate([sets[i] for i in some]), np.repeat(some, size[some]), band, differ):
            keys.append(k >> tk.U64(64 - _BITS))
            owners.append(owner.astype(np.int32))
            which, at = np.unique(owner, return_inverse=True)
            groups.append((at + len(need)).astype(np.int32))
            need.extend([n] * len(which))
    if not keys:
        z = np.zeros(0, np.int32)
        return np.zeros(0, tk.U64), z, z, z, size
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(groups), np.array(need), size


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit words: how many of the set's shingles hash to each, modulo 2. There are at least twice as many bits as shingles."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    place = tk.mix(shingles + _STEP) & tk.U64(width - 1)
    odd = np.bincount(place.astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(tk.U64)


class Maps:
    """The parity maps of many sets, by number."""

    def __init__(self, maps: list[np.ndarray]):
        self.width = np.array([len(m) for m in maps], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.width)[:-1])) if len(maps) else self.width
        self.words = np.concatenate(maps) if len(maps) else np.zeros(0, tk.U64)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of numbers, in how many bits the maps differ; the larger map is folded to the smaller one's size."""
        out = np.zeros(len(x), np.int64)
        w = self.width[x] * (1 << 32) + self.width[y]
        for both in np.unique(w):
            hit = np.flatnonzero(w == both)
            least = min(int(both) >> 32, int(both) & 0xFFFFFFFF)
            for lo in range(0, len(hit), max(1, (1 << 20) // least)):
                some = hit[lo : lo + max(1, (1 << 20) // least)]
                sides = []
                for at, width in ((x[some], int(both) >> 32), (y[some], int(both) & 0xFFFFFFFF)):
                    m = self.words[self.at[at][:, None] + np.arange(least)]
                    for k in range(least, width, least):
                        m = m ^ self.words[self.at[at][:, None] + np.arange(k, k + least)]
                    sides.append(m)
                out[some] = np.bitwise_count(sides[0] ^ sides[1]).sum(1)
        return out


def may_link(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)


def close(maps: Maps, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of numbers the maps allow to be links."""
    return (100 + percent) * maps.differ(x, y) <= (100 - percent) * (n[x] + n[y])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def neighbours(key: np.ndarray, component: np.ndarray, side: np.ndarray | None, n: np.ndarray, maps: Maps, percent: int):
    """Pairs of row numbers with one key, of different components (and sides, if given), that may be links: piece by piece."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    end = np.searchsorted(k, k, "right")
    live, step = np.arange(len(k)), 1
    while True:
        live = live[live + step < end[live]]
        if not len(live):
            return
        x, y = order[live], order[live + step]
        good = (component[x] != component[y]) & may_link(n[x], n[y], percent)
        if side is not None:
            good &= side[x] != side[y]
        x, y = x[good], y[good]
        good = close(maps, n, x, y, percent)
        if good.any():
            yield x[good], y[good]
        step += 1


_PRESS = functools.partial(zstandard.ZstdCompressor, level=1)


def press(texts: list) -> list:
    c = _PRESS()
    return [None if t is None else c.compress(t.encode()) for t in texts]


def unpress(bodies: list) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of compressed texts, as of textkernel.pack."""
    d = zstandard.ZstdDecompressor()
    texts = [d.decompress(z) if z else b"" for z in bodies]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _sets(docs: DataFrame, n_words: int, *keep: str) -> DataFrame:
    """A table with each row's name, doc_id, set size, set fingerprint, bytes, text (compressed), and what else is kept."""

    def prints(batches):
        for b in tk.slices(batches):
            buf, off = tk.pack(b.column("text"))
            sets = shingle_sets(buf, off, n_words)
            mark = [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets]
            more = [int(tk.mix(s).sum().view(np.int64)) if len(s) else 0 for s in sets]
            cols = [pa.array(v, pa.int64()) for v in ([len(s) for s in sets], mark, more, np.diff(off))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(press(b.column("text").to_pylist()), pa.binary()), b.column("kept")], ["doc_id", "n_shingles", "p", "q", "size", "body", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*keep, F.lit(True).alias("_")).alias("kept"))
    out = f"doc_id long, n_shingles long, p long, q long, size long, body binary, kept {rows.schema['kept'].dataType.simpleString()}"
    return written(rows.mapInArrow(prints, out).withColumn("row", F.monotonically_increasing_id()))


def _found(sets: DataFrame, heads: DataFrame, n_words: int, percent: int, ratio: float) -> DataFrame:
    """row, n, leader, keys, map, body of the class heads that share a segment with others."""
    total = sets.where("n_shingles > 0").agg(F.sum("size")).first()[0] or 0
    n_blocks, n_buckets = max(1, -(-total // exchange.BLOCK_BYTES)), max(1, total // 12 // KEYS_PER_BUCKET)
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = sets.where("n_shingles > 0").select(block, "row", "body")
    heads = heads.select(block, "row")

    def prepared(rows: pa.Table, chosen: pa.ChunkedArray):
        """A block's heads, their sets and their keys."""
        rows = rows.filter(pc.is_in(rows.column("row"), value_set=chosen.combine_chunks() if isinstance(chosen, pa.ChunkedArray) else chosen)).sort_by("row").combine_chunks()
        sets = shingle_sets(*unpress(rows.column("body").to_pylist()), n_words)
        return (rows, sets, *_keys(sets, percent, ratio))

    def ask(key, rows, chosen):
        rows, _, k, owner, *_ = prepared(rows, chosen.column("row"))
        if not len(k):
            return MESSAGE.empty_table()
        order = np.argsort(k, kind="stable")  # owners ascend
        owner, k = owner[order], k[order]
        at = np.flatnonzero(np.diff(k, prepend=~k[0]))
        named = rows.column("row").to_numpy()[owner[at]]
        return pa.Table.from_pylist(send(key[0].as_py(), 1, n_buckets, k[at], named, np.diff(np.append(at, len(k))).astype(np.uint32)), MESSAGE)

    def tell(key, rows):
        sender, k, (row, n) = receive(rows, n_buckets)
        order = np.lexsort((row, k))
        at = np.flatnonzero(np.diff(k[order], prepend=~k[order][0]))
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        total, first = np.zeros(len(k), np.uint32), np.zeros(len(k), np.int64)
        total[order] = np.add.reduceat(n[order], at)[of]
        first[order] = row[order][at][of]
        first[total < 2] = 0
        return reply(rows, sender, 1, total, first)

    def candidates(key, rows, told):
        rows, sets, k, owner, group, need, _ = prepared(rows, told.filter(pc.equal(told.column("kind"), 0)).column("head"))
        if not len(k):
            return schema.empty_table()
        distinct, inverse = np.unique(k, return_inverse=True)
        total, first = answers(told, 1, distinct, n_buckets, [np.uint32, np.int64])
        rank = np.lexsort((k, total[inverse], group))  # the rarest first, in each set and band
        place = np.arange(len(k)) - np.repeat(np.searchsorted(group[rank], np.arange(len(need))), np.bincount(group, minlength=len(need)))
        taken = rank[(place < need[group[rank]]) & (total[inverse][rank] > 1)]
        names = rows.column("row").to_numpy()
        bodies = rows.column("body").to_pylist()
        taken = taken[np.argsort(owner[taken], kind="stable")]
        cut = np.searchsorted(owner[taken], np.arange(len(sets) + 1))
        out = []
        for i in np.flatnonzero(np.diff(cut)):
            mine = inverse[taken[cut[i] : cut[i + 1]]]
            leader = first[mine]
            leader = leader[leader != names[i]]
            best = None
            if len(leader):
                who, often = np.unique(leader, return_counts=True)
                best = int(who[often.argmax()])
            out.append({"row": int(names[i]), "n": len(sets[i]), "leader": best, "keys": np.unique(distinct[mine]).astype(np.int64), "map": parity_map(sets[i]).tobytes(), "body": bodies[i]})
        return pa.Table.from_pylist(out, schema) if out else schema.empty_table()

    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("leader", pa.int64()), ("keys", pa.list_(pa.int64())), ("map", pa.binary()), ("body", pa.binary())])
    told = blocks.groupBy("block").cogroup(heads.groupBy("block")).applyInArrow(ask, MESSAGE_SQL).groupBy("bucket").applyInArrow(tell, MESSAGE_SQL)
    both = told.withColumn("head", F.lit(None).cast("long")).unionByName(heads.select("block", F.lit(0).alias("bucket"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("body"), F.col("row").alias("head")))
    return written(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(candidates, "row long, n long, leader long, keys array<long>, map binary, body binary"))


def verified(pairs: DataFrame, found: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by their parity maps, then by the shingle sets of the whole texts."""
    side = {c: found.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")) for c in "ab"}

    def allowed(batches):
        for batch in batches:
            maps = Maps([np.frombuffer(m, tk.U64) for c in "ab" for m in batch.column(f"map_{c}").to_pylist()])
            n = np.concatenate([batch.column(f"n_{c}").to_numpy() for c in "ab"])
            x = np.arange(batch.num_rows)
            good = may_link(n[x], n[x + len(x)], percent) & close(maps, n, x, x + len(x), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    likely = written(pairs.join(side["b"], "b").join(side["a"], "a").mapInArrow(allowed, "a long, b long"))
    body = {c: found.select(F.col("row").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab"}

    def verify(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingle_sets(*unpress(part.column(f"body_{c}").to_pylist()), n_words) for c in "ab"]
                yield part.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in zip(*sets)], pa.bool_()))

    return likely.join(body["b"], "b").join(body["a"], "a").mapInArrow(verify, "a long, b long")


class Joined:
    """Components by union."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def across(rest: DataFrame, found: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links (a, b) across components that share a key: a spanning forest of each tile's.

    rest: row, n, component, key, g (how many share the key). Keys are dealt out in buckets,
    more of them as there are more rows; the sets of a key with more than TILE go to tiles of
    TILE by TILE. A first pass by sizes and maps leaves rows that may have a link in their tile;
    only those fetch their texts.
    """
    t = F.ceil(F.col("g") / TILE).cast("int")
    side = F.pmod(F.xxhash64("row"), t).cast("int")
    rows = rest.withColumn("t", t).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    # tiles (i, j) with i <= j: a set is in those of its own row and column
    rows = rows.select("key", "row", "n", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def dealt(rows: DataFrame, per_task: int) -> tuple:
        n = max(1, (rows.count() + per_task - 1) // per_task)
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n))).groupBy("bucket", "i", "j")

    def sides(rows: pa.Table):
        return rows.column("side").to_numpy() if rows.column("i")[0].as_py() != rows.column("j")[0].as_py() else None

    def hopeful(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, component, n = (rows.column(c).to_numpy() for c in ("key", "component", "n"))
        hit = np.zeros(rows.num_rows, bool)
        for x, y in neighbours(key, component, sides(rows), n, Maps([np.frombuffer(m, tk.U64) for m in rows.column("map").to_pylist()]), percent):
            hit[x] = hit[y] = True
        return rows.select(["key", "row", "n", "component", "side", "i", "j"]).filter(pa.array(hit))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, row, component, n = (rows.column(c).to_numpy() for c in ("key", "row", "component", "n"))
        who, at, of = np.unique(row, return_index=True, return_inverse=True)
        sets = shingle_sets(*unpress(rows.column("body").take(pa.array(at)).to_pylist()), n_words)
        maps = [parity_map(s) for s in sets]
        done = Joined(len(who))
        first: dict[int, int] = {}
        for i, c in enumerate(component[at].tolist()):
            done.join(i, first.setdefault(c, i))
        a, b = [], []
        for x, y in neighbours(key, component, sides(rows), n, Maps([maps[i] for i in of]), percent):
            for i, j in zip(of[x].tolist(), of[y].tolist()):
                if done.root(i) != done.root(j) and linked(sets[i], sets[j], percent):
                    done.join(i, j)
                    a.append(int(who[i]))
                    b.append(int(who[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    wide = written(rows.join(found.select("row", "map"), "row"))
    some = written(dealt(wide, PAIR_ROWS).applyInArrow(hopeful, "key long, row long, n long, component long, side int, i int, j int"))
    return dealt(some.join(found.select("row", "body"), "row"), BODY_ROWS).applyInArrow(compare, "a long, b long")


def _mixed(named: DataFrame) -> DataFrame:
    """key, g, head of the keys whose sets aren't in one component; of keys with the same sets, one."""
    found = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("g"), F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("row")).alias("p"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("q"),
        F.min_by(F.struct("row", "component"), F.xxhash64("row")).alias("head"),
    ).where("x < y")
    return found.groupBy("g", "p", "q").agg(F.min(F.struct("key", "head")).alias("k")).select("k.key", "g", "k.head")


def _linked(found: DataFrame, n_words: int, percent: int) -> DataFrame:
    """id, component of all candidates with links, by rounds of pairs between components that still share a segment."""
    first = found.where("leader is not null").select(F.col("row").alias("a"), F.col("leader").alias("b"))
    labels = written(components(verified(first, found, n_words, percent), "a", "b"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("id", "row"), "row", "left").select("row", "n", F.coalesce("component", "row").alias("component"), "key")

    # components only grow: a key whose sets are in one stays so, and needn't be looked at again
    rest = named(found.select("row", "n", F.explode("keys").alias("key")))
    rest = written(rest.join(_mixed(rest), "key"))
    pairs = rest.where("component <> head.component").selectExpr("row as a", "head.row as b").distinct()
    labels = _merged(labels, verified(pairs, found, n_words, percent))
    rest = written(named(rest.select("row", "n", "key")))
    rest = rest.join(_mixed(rest).drop("head"), "key")
    return _merged(labels, across(rest, found, n_words, percent))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b): only components that these join are sought anew."""
    links = written(links)
    ends = [labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c")) for c in ("a", "b")]
    joined = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    moved = written(components(joined.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")), "a", "b")).withColumnRenamed("component", "to")
    fresh = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    every = labels.unionByName(fresh)
    return written(every.join(moved.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def _members(docs: DataFrame, n_words: int, percent: int, ratio: float, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(sets, members): the table of _sets; and row, doc_id, n_shingles, component_id, first of each of its rows."""
    sets = _sets(docs, n_words, *keep)
    mark = ["n_shingles", "p", "q"]
    named, void = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
    classes = sets.where("n_shingles > 0").groupBy(*mark).agg(F.min(F.when(named, F.struct("doc_id", "row"))).alias("least"), F.min(F.when(void, F.col("row"))).alias("void"), F.count(F.lit(1)).alias("g"))
    classes = written(classes.withColumn("head", F.coalesce("least.row", "void")))
    heavy = heavy_keys(classes, "g", mark, sets.count())
    labels = _linked(_found(sets, classes.select(F.col("head").alias("row")), n_words, percent, ratio), n_words, percent)
    joined = classes.join(labels, F.col("head") == F.col("id")).groupBy("component").agg(F.min("least").alias("c_least"), F.min("void").alias("c_void"))
    known = classes.join(labels.join(joined, "component"), F.col("head") == F.col("id"), "left")
    known = known.select(*mark, F.coalesce("c_least", "least").alias("least"), F.when(F.col("id").isNull(), F.col("void")).otherwise(F.col("c_void")).alias("void"))
    rows = sets.select("row", "doc_id", *mark)
    members = join_split(rows, known, mark, heavy)
    bare = F.col("n_shingles") == 0
    first = bare | F.coalesce(F.col("row") == F.col("least.row"), F.lit(False)) | F.coalesce(F.col("row") == F.col("void"), F.lit(False))
    return sets, members.select("row", "doc_id", "n_shingles", F.when(bare, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, ratio: float = RATIO) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, first for each row.

    first: whether the row is the one of its component that stays when copies go, the first with
    a doc_id; of the rows without doc_id, one of each component is a first, too.
    """
    return _members(docs, n_words, percent, ratio)[1].drop("row")


def without_copies(docs: DataFrame, *keep: str, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, keep...) -> doc_id, text, keep... of the rows that are the first of their component."""
    sets, members = _members(docs, n_words, percent, RATIO, *keep)
    left = sets.select("row", "doc_id", "body", "kept").join(members.where("first").select("row"), "row").drop("row")

    def restore(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            texts = pa.array([None if z is None else d.decompress(z).decode() for z in b.column("body").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("kept")], ["doc_id", "text", "kept"])

    whole = left.mapInArrow(restore, f"doc_id long, text string, kept {left.schema['kept'].dataType.simpleString()}")
    return whole.select("doc_id", "text", *[F.col("kept")[k].alias(k) for k in keep])


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
