"""Suffix-array deduplication of repeated byte strings across and inside documents.

A byte goes if a string of `span` (100) bytes covers it that also starts earlier: in a smaller
doc_id, or before it in its document; the input decides, not what is left.

1. Fingerprints: in each string of `span` bytes the leftmost gram of GRAM bytes with the
   smallest hash is its anchor, so equal strings have equal anchors. The strings of one
   anchor lie side by side; their bytes are the anchor's segment. Rows carry hashes, not bytes,
   and are packed: a task sends one body of rows to each range of the anchor's hash. It takes
   equal segments of its documents together: all but the first repeat. Segments count as equal
   if the 64-bit hashes of both the anchor and the segment are (128 bits in all).
2. Rows meet by the range of the anchor's hash. Lone anchors go. Of equal segments all but the first
   repeat whole. Anchors with several different segments go on, each segment's first place.
3. Those segments' bytes are fetched from their documents, dealt out by anchor, cut to what
   can agree with another one and sorted in bounded blocks by suffix_array(); in its order, suffixes that share `span` bytes stand
   together, and all but each class's first place repeat.
   Anchors with over MOST different segments don't fit a block: their strings are compared
   one by one through 128-bit hashes instead, grouped by string.
4. A document's repeats are joined into runs, and what is left is hashed.

Defined cases: null text is empty; texts of under `span` bytes lose nothing; null ids come
before all others, repeated ids are ordered by their texts' hash, and identical rows count
as one document (equal starts, so neither is earlier); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, release, stored, table
from .jaccard_join import _BYTES, _MULT, _mix, _powers, groups, whole
from .suffix_array import suffix_array

SPAN = 100
GRAM = 28
MOST = 4000  # different segments of an anchor that are sorted in one block
BLOCK = 1 << 16  # bytes of a suffix array
PART = 1 << 22  # strings of a document that are looked at together
TOGETHER = 4 << 20  # bytes of texts that a task looks at together
PACK = 8 << 20  # bytes of packed rows that a task takes together


class Prints:
    """Segments of a text: anchor's hash, segment's hash, anchor's place, bytes before and from it."""

    def __init__(self, span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.n = span, gram, 0

    def _grow(self, n: int) -> None:
        self.n = n
        self.up, self.down = _powers(n + 1, _MULT), _powers(n + 1, pow(_MULT, -1, 1 << 64))

    def __call__(self, raw: bytes) -> list[tuple]:
        """A tuple of arrays for each part of the text."""
        out = []
        for at in range(0, max(0, len(raw) - self.span + 1), PART):
            out.append(self._part(raw[at : at + PART + self.span - 1], at))
        return out

    def _part(self, raw: bytes, shift: int) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        n, span, gram = len(data), self.span, self.gram
        if n >= self.n:
            self._grow(2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=total[1:])
        hashes = _mix((total[gram:] - total[: n + 1 - gram]) * self.down[: n + 1 - gram])
        # 40 bits of the hash, then the place: the least is the leftmost of the smallest
        key = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        wide = span - gram + 1
        m = -(-len(key) // wide) * wide
        padded = np.full(m, 0xFFFFFFFFFFFFFFFF, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - span + 1
        least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        begin = np.concatenate([[0], edge])
        last = np.concatenate([edge - 1, [windows - 1]])
        place = (least[begin] & np.uint64(0xFFFFFF)).astype(np.int64)
        end = last + span
        body = _mix((total[end] - total[begin]) * self.down[begin] + (place - begin).astype(np.uint64) * np.uint64(1 << 32) + (end - begin).astype(np.uint64))
        return hashes[place], body, place + shift, place - begin, end - place


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end), by start."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)]


def identified(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """rid (orders documents), doc_id and text. rid is doc_id where that is unique and not null."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    odd = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not odd.limit(1).count():
        return own.withColumn("rid", F.col("doc_id"))
    keyed = own.withColumn("key", F.xxhash64("text"))
    order = stored(spark, keyed.select("doc_id", "key").distinct().orderBy("doc_id", "key").withColumn("rid", F.monotonically_increasing_id()), "ids")
    order = order.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "rid")
    return stored(spark, keyed.join(order, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("doc_id", "text", "rid"), "documents")


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


_PRINT = ["f", "seg", "rid", "place", "left", "right"]
_ROW = np.dtype([("f", "<u8"), ("seg", "<u8"), ("rid", "<i8"), ("place", "<u4"), ("left", "u1"), ("right", "u1")])  # of a body: column after column


def prints(docs: DataFrame, parts: int, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """part, body: segments' rows, packed by ranges of the anchor's hash. part < 0: what already repeats, as packed runs."""

    def run(batches):
        make = Prints(span, gram)
        for batch in batches:
            held, size, at = [], 0, 0
            ids = batch.column(0).to_pylist()
            for i, t in enumerate(batch.column(1).to_pylist()):
                held += [(*p, ids[i]) for p in make(t.encode())]
                size += len(t)
                if size >= TOGETHER or i == len(ids) - 1:
                    if held:
                        yield from packed(held)
                    held, size = [], 0

    def packed(rows):
        sizes = [len(r[0]) for r in rows]
        f, seg, place, left, right = (np.concatenate([r[i] for r in rows]) for i in range(5))
        rid = np.repeat(np.array([r[5] for r in rows], np.int64), sizes)
        order = np.lexsort((place, rid, seg, f))
        f, seg, place, left, right, rid = (v[order] for v in (f, seg, place, left, right, rid))
        again = np.zeros(len(f), bool)
        again[1:] = (f[1:] == f[:-1]) & (seg[1:] == seg[:-1])
        # a repeated row's place is no repeat of itself
        twin = np.zeros(len(f), bool)
        twin[1:] = again[1:] & (rid[1:] == rid[:-1]) & (place[1:] == place[:-1])
        keep, gone = ~again, again & ~twin
        bodies, at = [], []
        if gone.any():
            runs = _runs(rid[gone], (place - left)[gone], (place + right)[gone])
            bodies.append(b"".join(v.astype("<i8").tobytes() for v in runs))
            at.append(-1 - int(f[0] % np.uint64(parts)))  # any task may hand them on
        columns = [v[keep].astype(_ROW[n]) for n, v in zip(_ROW.names, (f, seg, rid, place, left, right))]
        bounds = np.searchsorted((columns[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            bodies.append(b"".join(v[bounds[i] : bounds[i + 1]].tobytes() for v in columns))
            at.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    return docs.select("rid", "text").mapInArrow(lean(run), "part int, body binary")


def _runs(rid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, end) of the maximal runs of each document."""
    order = np.lexsort((starts, rid))
    rid, starts, ends = rid[order], starts[order], ends[order]
    # a document's ends are moved beyond those of the ones before, so that one running maximum does for all
    new = np.ones(len(rid), bool)
    new[1:] = rid[1:] != rid[:-1]
    shift = (np.cumsum(new) - 1) * (int(ends.max()) + 1)
    s, e = merge(starts + shift, ends + shift)
    at = np.searchsorted(starts + shift, s)
    return rid[at], starts[at], e - shift[at]


def _spans(rid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Runs of each document as rows that meet() gives: right = -1 marks a repeat, [place, left) of rid goes."""
    rid, s, e = _runs(rid, starts, ends)
    none = np.zeros(len(rid), np.int64)
    return _batch([none, none, rid, s, e, none - 1], _PRINT)


def meet(rows: DataFrame, parts: int) -> DataFrame:
    """prints()'s rows by anchor: repeats (right = -1) and first places of segments whose anchor has others; seg: 1 if the anchor has over MOST."""

    def unpacked(bodies):
        at, out = 0, []
        for name in _ROW.names:
            kind = _ROW[name]
            out.append(np.concatenate([np.frombuffer(b, kind, (n := len(b) // _ROW.itemsize), n * at) for b in bodies]))
            at += kind.itemsize
        return [v if v.dtype == np.uint64 else v.astype(np.int64) for v in out]

    def together(bodies):
        """Batches of whole anchors."""
        f, seg, rid, place, left, right = unpacked(bodies)
        order = np.argsort(f, kind="stable")
        f = f[order]
        same = f[1:] == f[:-1]
        company = np.zeros(len(f), bool)
        company[1:] |= same
        company[:-1] |= same
        order, f = order[company], f[company]
        if not len(f):
            return
        seg, rid, place, left, right = (v[order] for v in (seg, rid, place, left, right))
        order = np.lexsort((place, rid, seg, f))
        f, seg, rid, place, left, right = (v[order] for v in (f, seg, rid, place, left, right))
        again = np.zeros(len(f), bool)
        again[1:] = (f[1:] == f[:-1]) & (seg[1:] == seg[:-1])
        twin = np.zeros(len(f), bool)
        twin[1:] = again[1:] & (rid[1:] == rid[:-1]) & (place[1:] == place[:-1])
        gone = again & ~twin
        if gone.any():
            yield _spans(rid[gone], (place - left)[gone], (place + right)[gone])
        f, rid, place, left, right = (v[~again] for v in (f, rid, place, left, right))
        begin = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
        size = np.repeat(np.diff(np.append(begin, len(f))), np.diff(np.append(begin, len(f))))
        several = size > 1
        if several.any():
            yield _batch([f[several].view(np.int64), (size > MOST)[several].astype(np.int64), rid[several], place[several], left[several], right[several]], _PRINT)

    def run(batches):
        for (part,), (_, bodies) in groups(batches, 1):
            if part < 0:
                for body in bodies:
                    three = np.frombuffer(body, "<i8").reshape(3, -1)
                    yield _spans(*three)
            else:
                yield from together(bodies)

    return whole(rows, parts, "part").mapInArrow(lean(run), "f long, seg long, rid long, place long, left long, right long")


def by_document(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rid and arrays of its rows' columns: a document's own rows, bounded by its length."""
    return rows.groupBy(F.col("rid").alias("__rid")).agg(*[F.collect_list(c).alias("l_" + c) for c in columns])


def segments(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """f, hot, rid, start, left (bytes before the anchor) and bytes (body) of the segments' rows."""
    rows = rows.select("f", F.col("seg").alias("hot"), "rid", "left", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))
    wanted = by_document(rows.select("rid", F.struct("f", "hot", "start", "end", "left").alias("s")), ["s"])
    own = docs.select("rid", "text").dropDuplicates(["rid"]) if "rid" not in docs.columns else docs.select("rid", "text")
    joined = own.join(wanted, F.col("rid") == F.col("__rid")).select("rid", "text", F.col("l_s").alias("s"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rid, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                flat = batch.column(2).slice(i, 1).flatten()
                f, hot, start, end, left = (flat.field(k) for k in range(5))
                body = [raw[a:b] for a, b in zip(start.to_pylist(), end.to_pylist())]
                yield pa.RecordBatch.from_arrays([f, hot, pa.array([rid] * len(body), pa.int64()), start, left, pa.array(body, pa.binary())], names=["f", "hot", "rid", "start", "left", "body"])

    return joined.mapInArrow(lean(run), "f long, hot long, rid long, start long, left long, body binary")


def repeats_in(block: list[tuple], span: int = SPAN) -> list[tuple[int, int, int]]:
    """(rid, start, end) of the strings in a block of (rid, start, bytes) that also start earlier in it."""
    text, origin, room = bytearray(), [], []
    for rid, start, body in block:
        n = len(body)
        origin += [(rid, start + i) for i in range(n)]
        room += range(n, 0, -1)
        text += body
    text = bytes(text)
    out = []
    order = [i for i in suffix_array(text) if room[i] >= span]
    k = 0
    while k < len(order):
        own = text[order[k] : order[k] + span]
        end = k + 1
        while end < len(order) and text[order[end] : order[end] + span] == own:
            end += 1
        if end - k > 1:
            places = sorted({origin[i] for i in order[k:end]})
            out += [(rid, s, s + span) for rid, s in places[1:]]
        k = end
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _most_common(parts: list[bytes]) -> list[int]:
    """For each part its longest common prefix with another one: neighbours in sorted order have it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(group: list[tuple], span: int = SPAN) -> list[tuple]:
    """(rid, start, bytes) of an anchor's segments (rid, start, bytes, left), cut to what can match another one.

    Equal strings of one anchor agree from the anchor on and before it; what agrees with no other
    segment on either side is in no string that occurs twice here.
    """
    after = _most_common([body[left:] for _, _, body, left in group])
    before = _most_common([body[:left][::-1] for _, _, body, left in group])
    return [(rid, start + left - x, body[left - x : left + y]) for (rid, start, body, left), x, y in zip(group, before, after) if x + y >= span]


def sort_segments(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rid, start, end: repeats among the segments of each anchor, whole anchors in blocks of about BLOCK bytes."""
    dealt = rows.repartition("f").sortWithinPartitions("f", "rid", "start")

    def run(batches):
        block, size, last, group, out = [], 0, None, [], []
        for batch in batches:
            for f, rid, start, body, left in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if f != last and group:
                    own, group = trimmed(group, span), []
                    block += own
                    size += sum(len(x[2]) for x in own)
                    if size >= BLOCK:
                        out += repeats_in(block, span)
                        block, size = [], 0
                    if len(out) > 50_000:
                        yield _rows(out)
                        out = []
                group.append((rid, start, body, left))
                last = f
        out += repeats_in(block + trimmed(group, span), span)
        if out:
            yield _rows(out)

    return dealt.select("f", "rid", "start", "body", "left").mapInArrow(lean(run), "rid long, start long, end long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    rid, start, end = (np.array(c, np.int64) for c in zip(*found))
    return _batch(list(_runs(rid, start, end)), ["rid", "start", "end"])


def compare_strings(spark: SparkSession, rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rid, start, end: repeats among the strings of crowded anchors, a row a string; all but each string's first place."""

    def run(batches):
        for batch in batches:
            h, ids, starts = [], [], []
            for rid, start, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for i in range(len(body) - span + 1):
                    h.append(hashlib.blake2b(body[i : i + span], digest_size=16).digest())
                    ids.append(rid)
                    starts.append(start + i)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64())], names=["h", "rid", "start"])

    strings = stored(spark, rows.select("rid", "start", "body").mapInArrow(lean(run), "h binary, rid long, start long"), "strings")
    first = strings.groupBy("h").agg(F.min(F.struct("rid", "start")).alias("m"), F.count("*").alias("n")).where("n > 1")
    again = strings.join(first.select("h", F.col("m.rid").alias("r0"), F.col("m.start").alias("s0")), "h").where("rid <> r0 or start <> s0")
    return again.select("rid", "start", (F.col("start") + span).alias("end"))


def find(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """rid, start, end: what repeats; docs from identified()."""
    # about one anchor in 36 bytes
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * _ROW.itemsize // 36 // PACK))
    met = stored(spark, meet(prints(docs, parts, span, gram), parts), "met")
    release(spark)  # the anchors' shuffle files
    out = met.where("right < 0").select("rid", F.col("place").alias("start"), F.col("left").alias("end"))
    several = met.where("right >= 0")
    parts = stored(spark, segments(spark, docs, several), "segments")
    release(spark)
    out = out.unionByName(sort_segments(parts.where("hot = 0"), span))
    if several.where("seg = 1").limit(1).count():
        out = out.unionByName(compare_strings(spark, parts.where("hot = 1"), span))
    return out


def cut(text: str | None, starts, ends) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, runs, what is left)."""
    raw = (text or "").encode()
    if starts is None or not len(starts):
        return len(raw), 0, 0, raw
    s, e = merge(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
    at, left = 0, []
    for a, b in zip(s, e):
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return len(raw), int((e - s).sum()), len(s), b"".join(left)


def remove(spark: SparkSession, docs: DataFrame, text: str = "text", span: int = SPAN, with_rest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row and, if asked for, the bytes that are left (rest)."""
    own = identified(spark, docs, text)
    spans = by_document(find(spark, own, span), ["start", "end"])
    joined = own.join(spans, F.col("rid") == F.col("__rid"), "left").select("doc_id", "text", "l_start", "l_end")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", rest binary" if with_rest else "")

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, t, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                n, removed, runs, left = cut(t, s, e)
                rows.append((doc_id, n, removed, runs, hashlib.sha256(left).hexdigest()) + ((left,) if with_rest else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_rest
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["rest"] * with_rest
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return joined.mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark, table(spark, sf_dir, "documents"))
