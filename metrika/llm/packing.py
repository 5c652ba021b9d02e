"""Best-fit packing of documents into sequences by linear grouping.

Documents become token ids plus an end id; only longer ones are cut, into pieces of the
sequence length. Piece lengths are counted (a bounded table: one row a length), and the
packing is solved on those counts:

1. Pieces of over `large` tokens are sorted by length and dealt into groups of (nearly) equal
   cardinality; within a group each is rounded up to the group's longest.
2. The few sizes that are left are optimised: again and again the configuration (multiset of
   sizes that fits a sequence) that fills most is found by a bounded knapsack and used as
   often as the counts allow.
3. The groups' actual lengths are put in the place of the rounded ones, longest first, which
   splits a configuration into runs of sequences with one composition each.
4. Smaller pieces go best-fit, longest first, into the runs' rests; what no rest takes opens
   new sequences.

Each run says which ranks of a length it holds and where. A piece's rank among those of its
length comes from counters of the task that made it and a running sum over tasks, so no
task and not the driver ever sees all pieces. Equal lengths are interchangeable.

Defined cases: null text is empty and still has its end id; repeated rows are separate
documents, also those of equal or null ids; pieces of one length may change places, so ties
don't matter; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stored, table
from .token_ids import Encoder

LENGTH = 2048
GROUPS = 512
MOST_RUNS = 2_000_000  # intervals that are broadcast; far above what counts of 2048 lengths give


def group_sizes(counts: dict[int, int], large: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(rounded size, [(length, count)] longest first)]: large pieces in groups of equal cardinality, longest first."""
    total = sum(c for n, c in counts.items() if n > large)
    per = max(1, -(-total // groups))
    out, room = [], 0
    for n in sorted((n for n in counts if n > large), reverse=True):
        c = counts[n]
        while c:
            if not room:
                out.append((n, []))
                room = per
            take = min(c, room)
            out[-1][1].append((n, take))
            room -= take
            c -= take
    return out


def fullest(sizes: list[int], left: list[int], capacity: int, need: int) -> list[int]:
    """How often each size is in the multiset that fills `capacity` most, with size `need` at least once (bounded knapsack)."""
    reach = np.full(capacity + 1, -1, np.int64)  # the item by which a sum is reached first
    reach[0] = len(sizes)
    room = capacity - sizes[need]
    for i, (size, n) in enumerate(zip(sizes, left)):
        n -= i == need
        used, k = reach >= 0, 0
        while k < min(n, room // size):
            # one more of this size on sums that it has just reached, or on all older ones
            source = np.flatnonzero(used[: room + 1 - size])
            target = source + size
            target = target[reach[target] < 0]
            if not len(target):
                break
            reach[target] = i
            used = np.zeros(capacity + 1, bool)
            used[target] = True
            k += 1
    at = int(np.flatnonzero(reach[: room + 1] >= 0)[-1])
    out = [0] * len(sizes)
    out[need] = 1
    while at:
        out[int(reach[at])] += 1
        at -= sizes[int(reach[at])]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(times, how often each size)], until every count is used up."""
    left, out = list(counts), []
    alive = [i for i, c in enumerate(left) if c]
    while alive:
        use = fullest([sizes[i] for i in alive], [left[i] for i in alive], capacity, 0)  # with the largest size that is left
        times = min(left[i] // u for i, u in zip(alive, use) if u)
        whole = [0] * len(sizes)
        for i, u in zip(alive, use):
            whole[i] = u
            left[i] -= times * u
        out.append((times, whole))
        alive = [i for i in alive if left[i]]
    return out


def substitute(groups: list, plan: list[tuple[int, list[int]]]) -> list[tuple[int, tuple[int, ...]]]:
    """[(sequences, actual lengths)] from configurations of rounded sizes."""
    at = [[list(x) for x in members] for _, members in groups]
    runs = []
    for times, use in plan:
        slots = []
        for g, u in enumerate(use):
            for _ in range(u):
                need, own = times, []
                while need:
                    take = min(need, at[g][0][1])
                    own.append((take, at[g][0][0]))
                    at[g][0][1] -= take
                    need -= take
                    if not at[g][0][1]:
                        at[g].pop(0)
                slots.append(own)
        while slots and slots[0]:
            n = min(s[0][0] for s in slots)
            runs.append((n, tuple(s[0][1] for s in slots)))
            for s in slots:
                left = s[0][0] - n
                s[0:1] = [(left, s[0][1])] if left else []
    return runs


def best_fit(runs: list[tuple[int, tuple[int, ...]]], small: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put the small pieces, longest first, where the least rest stays; runs are split as needed."""
    by_rest: dict[int, list] = {}
    rests: list[int] = []

    def add(n, items, rest):
        if rest not in by_rest:
            by_rest[rest] = []
            insort(rests, rest)
        by_rest[rest].append((n, items))

    for n, items in runs:
        add(n, items, capacity - sum(items))
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            i = bisect_left(rests, length)
            if i == len(rests):
                per = capacity // length
                full, more = divmod(left, per)
                for n, k in ((full, per), (1 if more else 0, more)):
                    if n:
                        add(n, (length,) * k, capacity - k * length)
                break
            rest = rests[i]
            n, items = by_rest[rest].pop()
            per = rest // length  # as many as fit one sequence
            if left >= n * per:
                used, k = n, per
            elif left >= n:
                used, k = n, left // n
            else:
                used, k = left, 1
            if used < n:
                by_rest[rest].append((n - used, items))
            if not by_rest[rest]:
                del by_rest[rest]
                rests.pop(i)
            add(used, items + (length,) * k, rest - k * length)
            left -= used * k
    return [x for rest in rests for x in by_rest[rest]]


def solve(counts: dict[int, int], capacity: int = LENGTH, groups: int = GROUPS, large: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (sequences, lengths of their pieces) that hold every counted piece."""
    large = capacity // 8 if large is None else large
    counts = dict(counts)
    full = counts.pop(capacity, 0)
    grouped = group_sizes(counts, large, groups)
    plan = configurations([size for size, _ in grouped], [sum(c for _, c in m) for _, m in grouped], capacity)
    runs = substitute(grouped, plan)
    runs = best_fit(runs, {n: c for n, c in counts.items() if n <= large}, capacity)
    return ([(full, (capacity,))] if full else []) + runs


def intervals(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by rank."""
    following: Counter = Counter()
    out: dict[int, list] = {}
    sequence = 0
    for n, items in runs:
        offset = 0
        for length in items:
            out.setdefault(length, []).append((following[length], sequence, offset))
            following[length] += n
            offset += length
        sequence += n
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, spaced: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids; task and rank count equal lengths within a task."""
    fields = "piece int, start long, length long, ids_crc32 long, task long, rank long" + (", ids binary" if with_ids else "")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encoder, task, seen = Encoder(path, spaced), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows: list[tuple] = []
                index = []
                for i, ids in enumerate(encoder.ids(part.column(1).to_pylist())):
                    ids += b"\0\0\0\0"
                    for k, s in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[s : s + 4 * length]
                        n = len(own) // 4
                        rows.append((k, s // 4, n, zlib.crc32(own), task, seen[n]) + ((own,) if with_ids else ()))
                        seen[n] += 1
                        index.append(i)
                kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.binary()] * with_ids
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                names = ["doc_id"] + [f.split()[0] for f in fields.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index))] + made, names=names)

    source = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("__text"))
    return source.mapInArrow(lean(run), f"doc_id {kind}, {fields}")


def place(found: DataFrame, length: int = LENGTH, groups: int = GROUPS) -> DataFrame:
    """pieces()'s rows, which must be stored, with sequence_id and offset."""
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    where = intervals(solve(totals, length, groups))
    if sum(map(len, where.values())) > MOST_RUNS:
        raise ValueError("more runs than a broadcast may hold; use fewer groups")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("task").alias("__task"), F.col("length").alias("__length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = found.join(base, (F.col("task") == F.col("__task")) & (F.col("length") == F.col("__length")))
    keep = [c for c in found.columns if c not in ("task", "rank")]
    ranked = ranked.select(*keep, (F.col("rank") + F.col("__base")).alias("rank"))
    shared = found.sparkSession.sparkContext.broadcast(where)

    def run(batches):
        rows = shared.value
        for batch in batches:
            n = batch.column(keep.index("length")).to_numpy()
            rank = batch.column(len(keep)).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                own = rows[int(length)]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                sequence[at] = own[k, 1] + rank[at] - own[k, 0]
                offset[at] = own[k, 2]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(sequence), pa.array(offset)], names=keep + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in keep)
    return ranked.mapInArrow(lean(run), schema + ", sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, groups: int = GROUPS, spaced: bool = False, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return place(stored(spark, pieces(docs, path, text, length, spaced, with_ids), "pieces"), length, groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
