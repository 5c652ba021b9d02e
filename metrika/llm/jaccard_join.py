"""Jaccard metric-space join: document pivots, regions with triangle-inequality windows, exact recursion.

The Jaccard distance d = 1 - |x and y| / |x or y| is a metric on sets; documents link at
d <= 0.2 (similarity 0.8).

1. Pivots and regions. Nearly all documents are at distance 1 from nearly all others, where
   nearest pivots say nothing: a boundary window of twice the link distance would replicate each
   document to every region. So a document's regions are those of the pivots that it can share
   a linked partner with: of its shingles in one global order (often seen ones last), the first
   |x| - ceil(0.8 |x|) + 1 are its window, and linked documents have a shingle of both windows in
   common. Among the documents of near sizes that have a shingle in their windows, the one of
   smallest digest is the pivot; all others are replicated to its region. Linked documents
   therefore meet in a region.
2. Distances to the pivots. Counts of a set's shingles by ranges of the hash are a contractive
   map: their L1 distance is at most the symmetric difference, so it bounds d from below and
   rules out pairs exactly. Other members' sets are brought to their pivot's (a crowded region
   is dealt out by salt, with a copy of the pivot's set for each part) and d is found exactly.
   Members within 0.2 of the pivot join its component.
3. Windows. Only members of different components can still matter to each other; two whose
   distances to the pivot differ by more than 0.2 can't link. Of the others the L1 bound leaves
   few; their sets come to the region, which is joined recursively: a new pivot, exact
   distances to it, then the two overlapping halves inside and outside of its median distance.
   Regions of over BLOCK such members are joined in pairs of blocks, without a cap.

Equal sets are one class from the start, by a 128-bit digest that is the class's key; rows of a
doc_id with several texts are in their own classes. Shingles are 64-bit hashes of the bytes of
the lower-cased words, which stand for the shingles.

Defined cases: without words or text a set is empty and links with nothing; a null doc_id
belongs to the class of its text's set; repeated rows belong to one class; a doc_id with
several texts takes part with each, and each row gets its own text's component; texts are used
whole; an empty table gives no rows; columns other than doc_id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lean, release, stored, table
from .graph import components

SHINGLE = 5
PERCENT = 80
OFTEN = 64  # classes from which on a shingle counts as often seen
LISTED = 1 << 20  # often seen shingles that are broadcast: the most frequent ones by powers of two
HOT = 1 << 18  # classes from which on a shingle's documents are not gathered in one task
PART = 8 << 20  # bytes of shingles or windows that a task takes together
SALT = 256  # members of a region for each copy of its pivot's set
BLOCK = 1000  # members that are compared in one task
BROADCAST = 16 << 20  # bytes

U8, I4, U = np.dtype("<u8"), np.dtype("<u4"), np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A fixed odd multiplier for positions and 64-bit values for bytes (splitmix64).
_MULT = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Shingler:
    """Sorted distinct shingle hashes of a text. Word hashes come from sums over prefixes of the bytes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.n = size, 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.n = n
        self.up = _powers(n + 1, _MULT)
        self.down = _powers(n + 1, pow(_MULT, -1, 1 << 64))

    def words(self, text: str) -> np.ndarray:
        data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
        if len(data) >= self.n:
            self._grow(2 * len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        edges = np.diff(inside)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=total[1:])
        return _mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text) if text else np.empty(0, np.uint64)
        return np.unique(self.hashes(words, min(len(words), self.size))) if len(words) else words

    def hashes(self, words: np.ndarray, wide: int) -> np.ndarray:
        """Of all runs of `wide` words."""
        n = len(words)
        out = np.zeros(n - wide + 1, np.uint64)
        for i in range(wide):
            out = (out ^ words[i : n - wide + 1 + i]) * np.uint64(_MULT)
            out ^= out >> np.uint64(29)
        return _mix(out + np.uint64(wide))

    def several(self, texts: list) -> list[np.ndarray]:
        """Of each of some texts (UTF-8 bytes or None), in one pass over their bytes."""
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        joined = b" ".join([t or b"" for t in texts])
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        if len(data) >= self.n:
            self._grow(2 * len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        edges = np.diff(inside)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=total[1:])
        words = _mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        stop = np.searchsorted(begin, ends).tolist()
        every = self.hashes(words, self.size) if len(words) >= self.size else None
        out, at = [], 0
        for to in stop:
            n = to - at
            if n < self.size:
                s = np.unique(self.hashes(words[at:to], n)) if n else np.empty(0, np.uint64)
            else:
                s = np.sort(every[at : to - self.size + 1])
                new = s[1:] != s[:-1]
                if not new.all():
                    s = np.concatenate([s[:1], s[1:][new]])
            out.append(s)
            at = to
        return out


def texts_by_size(column, most: int = 1 << 18):
    """(first row, UTF-8 bytes of each text) of slices of a string column, of about `most` bytes each."""
    held, size, at = [], 0, 0
    for t in column.cast(pa.binary()).to_pylist():
        held.append(t)
        size += len(t or b"")
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def window(n, percent: int = PERCENT):
    """How many of n shingles a linked set may lack, and one."""
    return n - -(-n * percent // 100) + 1


def in_order(s: np.ndarray, often: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sorted shingles in the global order: by how often they are seen (0: not listed), then by hash."""
    if not len(often) or not len(s):
        return s
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    rank = np.where(often[at] == s, level[at], 0)
    return s[np.argsort(rank, kind="stable")] if rank.any() else s


def counts_by_range(s: np.ndarray) -> np.ndarray:
    """How many of the shingles are in each of 2 ** k equal ranges of the hash, up to 255; about 8 a range."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(s)) / 8))))
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(v: np.ndarray, n: int) -> np.ndarray:
    """Counts by n ranges from counts by more; the ranges are along the last axis."""
    while v.shape[-1] > n:
        v = np.minimum(v[..., 0::2].astype(np.uint16) + v[..., 1::2], 255).astype(np.uint8)
    return v


def may_link(n: np.ndarray, gap: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n shingles together whose symmetric difference is at least `gap` can link."""
    return 100 * (n - gap) >= percent * (n + gap)


class Seen:
    """Keys that a task has met, so that copies are handed on once a task; drops all when full."""

    def __init__(self, most: int = 200_000):
        self.keys, self.most = set(), most

    def new(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return True


def sets(batches):
    """Lists of (key, sorted shingles) of a batch's texts (first column), without empty sets and copies that the task has met."""
    shingles, seen = Shingler(), Seen()
    for batch in batches:
        for _, texts in texts_by_size(batch.column(0)):
            out = [(key, s) for s in shingles.several(texts) if len(s) and seen.new(key := key_of(s))]
            if out:
                yield out


def binary(data: np.ndarray, width: int = 16) -> pa.Array:
    """An array of binary values of one width."""
    n = data.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def dealt_blobs(c: np.ndarray, parts: int, columns: list[np.ndarray]):
    """A record batch (part, body) of sorted c and its columns: a row for each part of the hash's range."""
    bounds = np.searchsorted((c >> U(32)) * U(parts) >> U(32), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds))
    body = [b"".join(v[bounds[i] : bounds[i + 1]].tobytes() for v in (c, *columns)) for i in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(body, pa.binary())], names=["part", "body"])


def groups(batches, keys: int):
    """(key, columns as lists) of whole groups of rows with equal first `keys` columns, which lie together."""
    last, held = None, None
    for batch in batches:
        rows = [c.to_pylist() for c in batch.columns]
        ids = list(zip(*rows[:keys]))
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if ids[at] != last:
                if held is not None:
                    yield last, held
                last, held = ids[at], [[] for _ in rows]
            for h, r in zip(held, rows):
                h += r[at:end]
            at = end
    if held is not None:
        yield last, held


def whole(df: DataFrame, parts: int, *keys: str, then: str = "") -> DataFrame:
    """df with the rows of equal keys side by side in one task."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *([then] if then else []))


def fits(df: DataFrame, size) -> DataFrame:
    """df (stored), marked for broadcast if its bytes, by the expression, are at most BROADCAST."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


class Regions:
    """A region's members and the links between them that are known, for the recursive join."""

    def __init__(self, members: list[np.ndarray], comps: list, percent: int = PERCENT):
        self.sets, self.n, self.percent = members, np.array([len(s) for s in members]), percent
        index: dict = {}
        self.parent = [index.setdefault(c, i) for i, c in enumerate(comps)]
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, own: list[int]) -> None:
        """Find links until members of `own` that link are in one component."""
        work = [own]
        while work:
            own = work.pop()
            if len(own) < 2 or len({self.find(i) for i in own}) < 2:
                continue
            q, rest = own[0], np.array(own[1:])
            flat = np.concatenate([self.sets[i] for i in rest])
            at = np.minimum(np.searchsorted(self.sets[q], flat), self.n[q] - 1)
            ends = np.cumsum(self.n[rest])
            hits = np.concatenate([[0], np.cumsum(self.sets[q][at] == flat)])
            common = hits[ends] - hits[ends - self.n[rest]]
            union = self.n[rest] + self.n[q] - common
            for i in rest[100 * common >= self.percent * union].tolist():
                if (a := self.find(q)) != (b := self.find(i)):
                    self.parent[b] = a
                    self.links.append((q, i))
            d, gap = 1 - common / union, (100 - self.percent) / 100 + 1e-9
            middle = float(np.median(d))
            inner, outer = rest[d <= middle].tolist(), rest[d > middle - gap].tolist()
            work += [inner, outer] if len(outer) < len(rest) else [rest.tolist()]


class Join:
    """The state of one join; every step's table is written to the shared folder; the largest, of frequent shingles, is removed when the next has read it, the others stay there."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str = "text", percent: int = PERCENT, often: int = OFTEN, hot: int = HOT, block: int = BLOCK):
        self.spark, self.percent, self.often, self.hot, self.block = spark, percent, often, hot, block
        self.docs = docs.select(F.col("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
        self.texts = self.docs.select("__text").where("__text is not null")
        self.signed = self.keep(self.signatures(), "signatures")
        self.shingles = self.signed.agg(F.sum("n_shingles")).first()[0] or 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(self.spark, df, name)
        release(self.spark)
        return out

    def parts(self, size: float) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART))

    def signatures(self) -> DataFrame:
        """doc_id, n_shingles, key of the set (null: empty) and vector, its counts by ranges."""

        def run(batches):
            shingles = Shingler()
            for batch in batches:
                for at, texts in texts_by_size(batch.column(1)):
                    found = shingles.several(texts)
                    keys = pa.array([key_of(s) if len(s) else None for s in found], pa.binary())
                    vectors = pa.array([counts_by_range(s).tobytes() if len(s) else None for s in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in found], pa.int64()), keys, vectors], names=["doc_id", "n_shingles", "key", "vector"])

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, key binary, vector binary")

    def often_seen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Often seen shingles, sorted, their levels (1, 2, ... by powers of two) and those that are hot.

        All shingles of all documents are counted (copies that one task holds count once). They
        only set the order of windows; the join is exact in any order.
        """
        parts = self.parts(12 * self.shingles)

        def count(batches):
            held, size = [], 0

            def flush():
                c, n = np.unique(np.concatenate(held), return_counts=True)
                return dealt_blobs(c, parts, [n.astype(I4)])

            for found in sets(batches):
                held += [s for _, s in found]
                size += sum(len(s) for _, s in found)
                if size > 1 << 19:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

        often = self.often

        def add(batches):
            for _, (_, bodies) in groups(batches, 1):
                c = np.concatenate([np.frombuffer(b, U8, len(b) // 12) for b in bodies])
                n = np.concatenate([np.frombuffer(b, I4, offset=len(b) // 12 * 8) for b in bodies])
                order = np.argsort(c, kind="stable")
                c, n = c[order], n[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                c, n = c[first], np.add.reduceat(n, first)
                c, n = c[n > often], n[n > often]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n)], names=["c", "n"])

        rows = whole(self.texts.mapInArrow(lean(count), "part int, body binary"), parts, "part").mapInArrow(lean(add), "c long, n long")
        rows = self.keep(rows.withColumn("level", (F.floor(F.log2(F.col("n") / often)) + 1).cast("int")), "often")
        left, least = LISTED, 1 << 30
        for r in rows.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # a row a power of two
            left -= r["k"]
            if left < 0:
                break
            least = r["level"]
        found = rows.where(F.col("level") >= least).toArrow()  # LISTED rows at most
        c, n, level = (found.column(i).to_numpy() for i in range(3))
        order = np.argsort(c.view(np.uint64))
        c, n, level = c.view(np.uint64)[order], n[order], level[order].astype(np.uint8)
        dropped(self.spark, rows)
        return c, level, c[n > self.hot]

    def stars(self) -> DataFrame:
        """(p, x, pn, xn): members of the regions with their pivots and the sizes of both."""
        often, level, hot = self.often_seen()
        listed, percent = self.spark.sparkContext.broadcast((often, level, hot)), self.percent
        parts = self.parts(28 * self.shingles * (100 - percent) / 100 * 1.2)

        def windows(only_hot):
            def run(batches):
                often, level, hot = listed.value
                held, size = [], 0

                def flush():
                    c = np.concatenate([h[1] for h in held])
                    sizes = [len(h[1]) for h in held]
                    keys = np.repeat(np.frombuffer(b"".join(h[0] for h in held), "V16"), sizes)
                    n = np.repeat(np.array([h[2] for h in held], I4), sizes)
                    is_hot = np.isin(c, hot) if len(hot) else np.zeros(len(c), bool)
                    pick = np.flatnonzero(is_hot == only_hot)
                    order = pick[np.argsort(c[pick], kind="stable")]
                    c, keys, n = c[order], keys[order], n[order]
                    if only_hot:
                        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), binary(keys), pa.array(n.astype(np.int64))], names=["c", "x", "xn"])
                    return dealt_blobs(c, parts, [keys, n])

                for found in sets(batches):
                    for key, s in found:
                        held.append((key, in_order(s, often, level)[: window(len(s), percent)], len(s)))
                        size += len(held[-1][1])
                    if size > 1 << 19:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

            return run

        def meet(batches):
            for _, (_, bodies) in groups(batches, 1):
                m = [len(b) // 28 for b in bodies]
                c = np.concatenate([np.frombuffer(b, U8, k) for b, k in zip(bodies, m)])
                keys = np.concatenate([np.frombuffer(b, U8, 2 * k, 8 * k) for b, k in zip(bodies, m)]).reshape(-1, 2)
                n = np.concatenate([np.frombuffer(b, I4, k, 24 * k) for b, k in zip(bodies, m)]).astype(np.int64)
                high, low = keys[:, 0], keys[:, 1]
                order = np.lexsort((low, high, n, c))
                c, high, low, n = c[order], high[order], low[order], n[order]
                new = np.ones(len(c), bool)
                new[1:] = (c[1:] != c[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                c, high, low, n = c[new], high[new], low[new], n[new]
                edge = np.ones(len(c), bool)
                edge[1:] = (c[1:] != c[:-1]) | (100 * n[:-1] < percent * n[1:])
                run = np.cumsum(edge) - 1
                several = np.bincount(run)[run] > 1
                run, high, low, n = run[several], high[several], low[several], n[several]
                if not len(run):
                    continue
                order = np.lexsort((low, high, run))
                run, high, low, n = run[order], high[order], low[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                p = np.repeat(first, np.diff(np.append(first, len(run))))
                x = np.flatnonzero(p != np.arange(len(p)))
                p = p[x]
                order = np.lexsort((low[x], high[x], low[p], high[p]))
                x, p = x[order], p[order]
                new = np.zeros(len(x), bool)
                new[:1] = True
                for v in (high[x], low[x], high[p], low[p]):
                    new[1:] |= v[1:] != v[:-1]
                x, p = x[new], p[new]
                for i in range(0, len(x), 50_000):
                    a, b = p[i : i + 50_000], x[i : i + 50_000]
                    pairs = [binary(np.stack([high[k], low[k]], axis=1)) for k in (a, b)]
                    yield pa.RecordBatch.from_arrays([*pairs, pa.array(n[a]), pa.array(n[b])], names=["p", "x", "pn", "xn"])

        schema = "p binary, x binary, pn long, xn long"
        out = whole(self.texts.mapInArrow(lean(windows(False)), "part int, body binary"), parts, "part").mapInArrow(lean(meet), schema)
        if len(hot):
            rows = self.keep(self.texts.mapInArrow(lean(windows(True)), "c long, x binary, xn long"), "hot").distinct()
            pivots = rows.groupBy("c").agg(F.min(F.struct("x", "xn")).alias("m")).select("c", F.col("m.x").alias("p"), F.col("m.xn").alias("pn"))
            out = out.unionByName(rows.join(pivots, "c").where("x <> p").select("p", "x", "pn", "xn"))
        return self.keep(out.distinct(), "stars")

    def brought(self, wanted: DataFrame) -> DataFrame:
        """`wanted` (key and other columns, one row a key) with each key's set, as bytes."""

        def run(batches):
            for found in sets(batches):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["__key", "set"])

        return self.texts.mapInArrow(lean(run), "__key binary, set binary").join(wanted, F.col("__key") == F.col("key")).drop("__key")

    def bounds(self, stars: DataFrame, vectors: DataFrame) -> DataFrame:
        """stars with `near`, whether the L1 bound lets the pair link, and `low`, the least distance by it."""
        percent = self.percent
        side = lambda k: vectors.select(F.col("key").alias(k), F.col("vector").alias(f"{k}_vector"))

        def run(batches):
            for batch in batches:
                gaps = []
                for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                    k = min(len(a), len(b))
                    gaps.append(int(np.abs(folded(a, k).astype(np.int16) - folded(b, k)).sum()))
                both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                gap = np.maximum(np.array(gaps), np.abs(batch.column(2).to_numpy() - batch.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(may_link(both, gap, percent)), pa.array(2.0 * gap / (both + gap))], names=["p", "x", "pn", "xn", "near", "low"])

        joined = stars.join(side("x"), "x").join(side("p"), "p")
        return joined.select("p", "x", "pn", "xn", "p_vector", "x_vector").mapInArrow(lean(run), "p binary, x binary, pn long, xn long, near boolean, low double")

    def measured(self, near: DataFrame) -> DataFrame:
        """(p, x, d, linked) of the pairs (p, x), exactly: sets meet their pivot's, crowded regions in several parts."""
        percent = self.percent
        salts = near.groupBy("p").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
        members = near.join(salts, "p").select(F.col("x").alias("key"), F.struct("p", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("at"))
        pivots = salts.select(F.col("p").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("key", F.struct(F.col("key").alias("p"), "salt", F.lit(0).alias("role")).alias("at"))
        wanted = self.keep(members.unionByName(pivots).groupBy("key").agg(F.collect_list("at").alias("all")), "wanted")  # a set's regions: a window's shingles at most
        rows = self.brought(fits(wanted, 48 + 64 * F.size("all"))).select("key", "set", F.explode("all").alias("at")).select("at.p", "at.salt", "at.role", "key", "set")

        def run(batches):
            pivot, key = None, None
            for batch in batches:
                out: list = []
                for p, salt, role, x, s in zip(*(c.to_pylist() for c in batch.columns)):
                    if role == 0:
                        pivot, key = np.frombuffer(s, U8), (p, salt)
                        continue
                    if key != (p, salt):
                        raise ValueError("a region's pivot is missing")
                    if out and out[-1][:2] == (p, x):
                        continue  # a copy that another task handed on too
                    s = np.frombuffer(s, U8)
                    common = int((pivot[np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)] == s).sum())
                    union = len(s) + len(pivot) - common
                    out.append((p, x, 1.0 - common / union, 100 * common >= percent * union))
                if out:
                    kinds = (pa.binary(), pa.binary(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["p", "x", "d", "linked"])

        parts = self.parts(8 * self.shingles)
        dealt = rows.repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "role", "key")
        return dealt.mapInArrow(lean(run), "p binary, x binary, d double, linked boolean").distinct()

    def cross(self, stars: DataFrame, found: DataFrame, labels: DataFrame | None, vectors: DataFrame) -> DataFrame | None:
        """(a, b): links between members of a region that are in different components, inside the window of its pivot."""
        percent, block = self.percent, self.block
        gap = (100 - percent) / 100 + 1e-9
        rows = stars.join(found, ["p", "x"], "left").select("p", "x", F.col("xn").alias("n"), F.coalesce("d", "low").alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))
        if labels is None:
            rows = rows.withColumn("comp", F.col("x"))
        else:
            rows = rows.join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("comp", F.coalesce("label", "x")).drop("label")
        rows = self.keep(rows, "members")
        open_ = rows.groupBy("p").agg(F.count("*").alias("m"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last").select("p", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
        # a block meets each block; a region of one block is one task's
        own = rows.join(open_, "p").withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = own.select("p", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "x", "n", "low", "high", "comp")
        own = own.join(vectors.select(F.col("key").alias("x"), "vector"), "x").select("p", "i", "j", "x", "n", "low", "high", "comp", "vector")

        def sift(batches):
            for (p, i, j), (_, _, _, x, n, low, high, comp, vector) in groups(batches, 3):
                n, low, high = np.array(n), np.array(low), np.array(high)
                order = np.argsort(n, kind="stable")
                ids: dict = {}
                comps = np.array([ids.setdefault(c, len(ids)) for c in comp])[order]
                n, low, high = n[order], low[order], high[order]
                vectors_ = [np.frombuffer(vector[k], np.uint8) for k in order]
                width = np.array([len(v) for v in vectors_])
                stacked = {w: np.stack([folded(vectors_[k], w) for k in np.flatnonzero((width == w) | (width == 2 * w))]) for w in np.unique(width).tolist()}
                begin = {w: int(np.searchsorted(width, w)) for w in stacked}
                involved = np.zeros(len(n), bool)
                until = np.searchsorted(percent * n, 100 * n, "right")  # sizes are sorted: near ones are next
                for k in range(len(n)):
                    w = int(width[k])
                    at = np.arange(k + 1, min(int(until[k]), begin[w] + len(stacked[w])))
                    at = at[(comps[at] != comps[k]) & (low[at] - high[k] <= gap) & (low[k] - high[at] <= gap)]
                    if len(at):
                        own_ = stacked[w]
                        away = np.abs(own_[at - begin[w]].astype(np.int16) - own_[k - begin[w]]).sum(axis=1)
                        at = at[may_link(n[at] + n[k], away, percent)]
                        if len(at):
                            involved[at] = involved[k] = True
                if involved.any():
                    pick = order[np.flatnonzero(involved)]
                    m = len(pick)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * m, pa.binary()), pa.array([i] * m, pa.int32()), pa.array([j] * m, pa.int32()), pa.array([x[k] for k in pick], pa.binary()), pa.array([comp[k] for k in pick], pa.binary())],
                        names=["p", "i", "j", "key", "comp"],
                    )

        parts = self.parts(8 * self.shingles)
        wanted = whole(own, parts, "p", "i", "j").mapInArrow(lean(sift), "p binary, i int, j int, key binary, comp binary")
        wanted = self.keep(wanted.groupBy("key").agg(F.collect_list(F.struct("p", "i", "j", "comp")).alias("all")), "sifted")  # a set's regions
        if wanted.limit(1).count() == 0:
            return None
        rows = self.brought(fits(wanted, 48 + 80 * F.size("all"))).select("key", "set", F.explode("all").alias("at")).select("at.p", "at.i", "at.j", "key", "at.comp", "set")

        def settle(batches):
            for _, (_, _, _, key, comp, set_) in groups(batches, 3):
                once = {k: (c, np.frombuffer(s, U8)) for k, c, s in zip(key, comp, set_)}
                keys = list(once)
                region = Regions([once[k][1] for k in keys], [once[k][0] for k in keys], percent)
                region.join(list(range(len(keys))))
                if region.links:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[e[s]] for e in region.links], pa.binary()) for s in (0, 1)], names=["a", "b"])

        return whole(rows, parts, "p", "i", "j").mapInArrow(lean(settle), "a binary, b binary")

    def solve(self) -> DataFrame | None:
        """(node, label) of all linked classes, by key; other classes are alone."""
        stars = self.stars()
        needed = stars.select(F.col("x").alias("key")).unionByName(stars.select(F.col("p").alias("key"))).distinct()
        needed = self.keep(needed, "needed")
        vectors = self.signed.where("key is not null").join(fits(needed, F.lit(48)), "key", "left_semi")
        vectors = self.keep(vectors.select("key", "vector").groupBy("key").agg(F.first("vector").alias("vector")), "vectors")
        bounded = self.keep(self.bounds(stars, vectors), "bounds")
        found = self.keep(self.measured(bounded.where("near").select("p", "x")), "distances")
        edges = found.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
        labels = components(self.spark, edges) if edges.limit(1).count() else None
        more = self.cross(bounded, found.select("p", "x", "d"), labels, vectors)
        if more is not None:
            more = self.keep(more, "links")
            if more.limit(1).count():
                labels = components(self.spark, edges.unionByName(more))
        return labels


def join(spark: SparkSession, docs: DataFrame, text: str = "text", percent: int = PERCENT, **knobs) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    state = Join(spark, docs, text, percent, **knobs)
    labels = state.solve()
    classes = state.signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("component"))
    if labels is not None:
        own = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        least = own.groupBy("label").agg(F.min("component").alias("least"))
        classes = own.join(least, "label").select("key", F.col("least").alias("component"))
    out = state.signed.join(classes, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def filter_documents(spark: SparkSession, docs: DataFrame, text: str = "text", **knobs) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id; the columns stay.

    Where doc_ids repeat or are null, rows are numbered and one row of a group stays all the same.
    """
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    name = "doc_id"
    if ids["n"] != ids["d"]:
        name = "__row"
        docs = stored(spark, docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(name, F.monotonically_increasing_id()), "numbered")
    own = docs.select(F.col(name).alias("doc_id"), F.col(f"`{text}`").alias("__t"))
    gone = stored(spark, join(spark, own, "__t", **knobs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")), "copies")
    kept = docs.join(fits(gone, F.lit(16)), F.col(name) == F.col("__gone"), "left_anti")
    return kept.drop("__row") if name == "__row" else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, table(spark, sf_dir, "documents"))
