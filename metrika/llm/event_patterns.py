"""Sequential patterns of clients' events by gaps and islands.

A client supports a pattern if it has events of its types in order, each after the one before
by more than 0 and at most `gap`, and the first and last at most `span` apart. No such choice
crosses a place where neighbouring events are more than a gap apart, so a client's time is
split there into islands, which are mined apart. An island may be as long as the table, so
time is also cut into chunks of CHUNK gaps; a chunk sees a span beyond its end, which is as
far as what begins in it can reach. Tasks get ranges of (client, chunk), sorted: a client's
chunks lie side by side, in one task or in several if they are many.

Within an island the latest start of what ends at an event never falls from one event to the
next. So for each pattern the dynamic program needs only its last end before an event and the
start that belongs to it, which also goes from one block of events to the next: memory is a
block's, however many events an island has. Types too rare to be in any kept pattern go first.

A task counts the patterns of the clients that it has wholly (none but its first and last may
have events elsewhere); the pairs of client and pattern of these two are made distinct by Spark.

Defined cases: events without client, time or type don't count; repeated events, and events of
one type at one time, are one; events at one time don't follow each other; types are compared
as they are, empty ones too; other columns are ignored; no events, no patterns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored, table

GAP, SPAN = 600_000_000, 1_200_000_000  # microseconds
CHUNK = 24
BLOCK = 50_000  # events that a task mines at once, at least
MOST_TYPES = 10_000  # frequent types that are broadcast


class Miner:
    """Ends of patterns in events that come in blocks, in the order of islands and time."""

    def __init__(self, gap: int, span: int, max_length: int):
        self.gap, self.span, self.max_length = gap, span, max_length
        self.last: dict = {}  # pattern -> (its last end, the start that belongs to it), in the island that goes on

    def ends(self, t: np.ndarray, new_island: np.ndarray, kind: np.ndarray) -> dict:
        """pattern (types) -> the events at which it ends, by place; new_island: whether one begins at an event."""
        if new_island[0]:
            self.last = {}
        # one axis of time for all islands, each too far from the next to be linked with it
        first = np.flatnonzero(new_island | (np.arange(len(t)) == 0))
        island = np.cumsum(new_island) - new_island[0]
        apart = int((t[np.append(first[1:], len(t)) - 1] - t[first]).max()) + 2 * (self.span + self.gap)
        u = t - t[first][island] + island * apart
        known = {p: (np.array([e - t[0]]), np.array([s - t[0]])) for p, (e, s) in self.last.items()}
        out, made = {}, dict(known)

        def add(pattern, at, starts):
            out[pattern] = at
            if len(pattern) < self.max_length:
                before = known.get(pattern)
                made[pattern] = (u[at], starts) if before is None else (np.concatenate([before[0], u[at]]), np.concatenate([before[1], starts]))

        kinds = np.unique(kind).tolist()
        for k in kinds:
            at = np.flatnonzero(kind == k)
            add((k,), at, u[at])
        for n in range(2, self.max_length + 1):
            for p in [p for p in made if len(p) == n - 1]:
                ends, starts = made[p]
                for k in kinds:
                    # p and k end together only where p without its first type and k do
                    at = out.get((*p[1:], k))
                    if at is None:
                        continue
                    j = np.searchsorted(ends, u[at]) - 1
                    fits = (j >= 0) & (u[at] - ends[j] <= self.gap) & (u[at] - starts[j] <= self.span)
                    if fits.any():
                        add((*p, k), at[fits], starts[j[fits]])
        shift = int(t[-1] - u[-1])
        self.last = {p: (int(e[-1]) + shift, int(s[-1]) + shift) for p, (e, s) in made.items() if u[-1] - e[-1] <= self.gap}
        return out


class Counts:
    """Supports of a task's clients, from sorted events."""

    def __init__(self, gap: int, span: int, max_length: int):
        self.gap, self.miner = gap, Miner(gap, span, max_length)
        self.names: dict = {}
        self.supports: dict = {}  # pattern -> [clients that the task has wholly, sum of their crc32]
        self.pairs: list = []  # of clients that may have events in other tasks
        self.client, self.found, self.first, self.end = None, set(), True, None

    def close(self, border: bool) -> None:
        """The client that was open has no more events in this task."""
        if border:
            self.pairs += [(self.client, p) for p in self.found]
        else:
            crc = zlib.crc32(str(self.client).encode())
            for p in self.found:
                have = self.supports.setdefault(p, [0, 0])
                have[0] += 1
                have[1] += crc
        self.found = set()

    def add(self, client: pa.Array, chunk: np.ndarray, t: np.ndarray, kind: list) -> None:
        """A block of sorted events: clients and kinds are coded, a list of values and places in it."""
        values, at = client
        kind = np.array([self.names.setdefault(n, len(self.names)) for n in kind[0]], np.int64)[kind[1]]
        new = np.ones(len(t), bool)
        new[1:] = (at[1:] != at[:-1]) | (chunk[1:] != chunk[:-1]) | (t[1:] - t[:-1] > self.gap)
        went_on = self.end is not None and self.client == values[at[0]]
        new[0] = not went_on or self.end[0] != chunk[0] or t[0] - self.end[1] > self.gap
        self.end = (chunk[-1], t[-1])
        begins = np.append(True, at[1:] != at[:-1])
        run, heads = np.cumsum(begins) - 1, at[begins]
        ends = self.miner.ends(t, new, kind)
        if not went_on and self.client is not None:
            self.close(self.first)
            self.first = False
        crc = np.array([zlib.crc32(str(values[h]).encode()) for h in heads], np.int64)
        most = len(heads) - 1
        whole_from = 1 if went_on or self.client is None else 0
        found_first, found_last = set(), set()
        for p, events in ends.items():
            own = run[events]
            own = own[np.append(True, own[1:] != own[:-1])]
            if whole_from and own[0] == 0:
                found_first.add(p)
            if own[-1] == most:
                found_last.add(p)
            own = own[(own >= whole_from) & (own < most)]
            if len(own):
                have = self.supports.setdefault(p, [0, 0])
                have[0] += len(own)
                have[1] += int(crc[own].sum())
        if whole_from:
            self.client = values[heads[0]]
            self.found |= found_first
            if most:
                self.close(self.first)
                self.first = False
        if most or not whole_from:
            self.found = found_last
        self.client = values[heads[-1]]

    def rows(self) -> list:
        """(types, client or None, support, crc) of all."""
        if self.client is not None:
            self.close(True)
        names = list(self.names)
        spelt = lambda p: [names[k] for k in p]
        return [(spelt(p), None, n, crc) for p, (n, crc) in self.supports.items()] + [(spelt(p), c, None, None) for c, p in self.pairs]


def _sorted_blocks(batches):
    """Blocks of at least BLOCK events without repeats; events of one time stay in one block."""
    rest, size = [], 0
    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            size += batch.num_rows
        if size >= BLOCK:
            whole = _distinct(pa.Table.from_batches(rest).combine_chunks())
            t = whole.column(2).to_numpy()
            others = np.flatnonzero((t != t[-1]) | (whole.column(1).to_numpy() != whole.column(1)[-1].as_py()))
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield whole.slice(0, cut)
            rest = whole.slice(cut).to_batches()
            size = whole.num_rows - cut
    if size:
        yield _distinct(pa.Table.from_batches(rest).combine_chunks())


def _codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _distinct(events: pa.Table) -> pa.Table:
    client, kind = _codes(events.column(0))[1], _codes(events.column(3))[1]
    chunk, t = events.column(1).to_numpy(), events.column(2).to_numpy()
    same = (client[1:] == client[:-1]) & (kind[1:] == kind[:-1]) & (chunk[1:] == chunk[:-1]) & (t[1:] == t[:-1])
    return events.filter(pa.array(np.append(True, ~same)))


def mine(spark: SparkSession, events: DataFrame, max_length: int = 4, gap: int = GAP, span: int = SPAN, min_clients: int = 2, min_percent: int = 10) -> DataFrame:
    """types (array), support, clients_crc of the patterns that enough clients support; events: client_id, t (microseconds), kind."""
    integral = isinstance(events.schema["client_id"].dataType, T.IntegralType)
    events = events.select(F.col("client_id").cast("long" if integral else "string"), F.col("t").cast("long"), F.col("kind").cast("string")).dropna()
    pairs = stored(spark, events.select("client_id", "kind").distinct(), "client-kinds")
    n = pairs.select("client_id").distinct().count()
    enough = (F.col("support") >= min_clients) & (F.col("support") * 100 >= min_percent * n)
    kinds = stored(spark, pairs.groupBy("kind").agg(F.count("*").alias("support")).where(enough).select("kind"), "kinds")
    kinds = F.broadcast(kinds) if kinds.count() <= MOST_TYPES else kinds
    length = CHUNK * gap
    start = F.col("t") - F.pmod("t", F.lit(length))
    seen = F.when(F.col("t") - start < span, F.array(start, start - length)).otherwise(F.array(start))
    # every earlier chunk that sees the event, where a span is longer than a chunk
    seen = seen if span <= length else F.sequence(start - -(-span // length) * length, start, F.lit(length))
    rows = events.join(kinds, "kind", "left_semi").select("client_id", F.explode(seen).alias("chunk"), "t", "kind")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "client_id", "chunk").sortWithinPartitions("client_id", "chunk", "t", "kind")
    names = ["types", "client_id", "support", "clients_crc"]
    kind_of = pa.int64() if integral else pa.string()

    def run(batches):
        counts = Counts(gap, span, max_length)
        for block in _sorted_blocks(batches):
            counts.add(_codes(block.column(0)), block.column(1).to_numpy(), block.column(2).to_numpy(), _codes(block.column(3)))
        made = counts.rows()
        for at in range(0, len(made), 10_000):
            own = list(zip(*made[at : at + 10_000]))
            kinds = [pa.list_(pa.string()), kind_of, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(own, kinds)], names=names)

    found = stored(spark, ranged.mapInArrow(lean(run), f"types array<string>, client_id {'long' if integral else 'string'}, support long, clients_crc long"), "supports")
    shared = found.where("client_id is not null").select("types", "client_id").distinct()
    shared = shared.select("types", F.lit(1).cast("long").alias("support"), F.crc32(F.col("client_id").cast("string")).alias("clients_crc"))
    whole = found.where("client_id is null").select("types", "support", "clients_crc").unionByName(shared)
    return whole.groupBy("types").agg(F.sum("support").alias("support"), F.sum("clients_crc").alias("clients_crc")).where(enough)


def with_wider(spark: SparkSession, patterns: DataFrame) -> DataFrame:
    """patterns with n_wider: how many longer ones of equal support become it by deleting entries; closed: none."""
    patterns = stored(spark, patterns, "patterns")
    shorter = F.expr("array_distinct(transform(sequence(1, shiftleft(1, size(types)) - 2), m -> filter(types, (x, i) -> (shiftright(m, i) & 1) = 1)))")
    wider = patterns.where(F.size("types") > 1).select("support", F.explode(shorter).alias("types")).groupBy("types", "support").agg(F.count("*").alias("n_wider"))
    n_wider = F.coalesce("n_wider", F.lit(0).cast("long"))
    return patterns.join(wider, ["types", "support"], "left").withColumn("n_wider", n_wider).withColumn("closed", F.col("n_wider") == 0)


def click_events(clicks: DataFrame) -> DataFrame:
    """client_id, t, kind: the clicks, and `open` and `shut` a second around those whose click_id's crc32 is divisible by 5."""
    if isinstance(clicks.schema["ts"].dataType, T.TimestampNTZType):
        seconds = (F.col("ts") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(24, 6)")
        t = (seconds * 1_000_000).cast("long")
    else:
        t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = clicks.select("client_id", t.alias("t"), "kind", F.crc32(F.col("click_id").cast("string")).alias("crc")).where("client_id is not null and t is not null and kind is not null")
    event = lambda late, kind: F.struct((F.col("t") + late).alias("t"), kind.cast("string").alias("kind"))
    around = F.array(event(0, F.col("kind")), event(-1_000_000, F.lit("open")), event(1_000_000, F.lit("shut")))
    made = F.when(F.col("crc") % 5 == 0, around).otherwise(F.array(event(0, F.col("kind"))))
    return rows.select("client_id", F.explode(made).alias("e")).select("client_id", "e.t", "e.kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_wider(spark, mine(spark, click_events(table(spark, sf_dir, "clicks"))))
    return found.select(F.array_join("types", ">").alias("pattern"), F.size("types").alias("length"), "support", "clients_crc", "n_wider", "closed")


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_STEP = """e{n} as (select e.client_id, p.pattern || '>' || e.kind as pattern, e.t, max(p.begun) begun from e{m} p join ev e on e.client_id = p.client_id and e.t > p.t and e.t - p.t <= 600000000
    group by 1, 2, 3 having e.t - max(p.begun) <= 1200000000)"""
_SUB = " union ".join(f"select pattern, support, array_to_string([{', '.join(f'w[{i + 1}]' for i in range(n) if m >> i & 1)}], '>') s from k4 where length = {n}" for n in (2, 3, 4) for m in range(1, 2**n - 1))
#: Every choice of events, step by step: of those that end at an event, the one that begins last can be continued longest. The crc32 by its table.
ORACLE = f"""with tb as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
    ck as (select client_id, epoch_us(ts) t, kind, {_CRC.format("click_id")} crc from clicks, tb where client_id is not null and ts is not null and kind is not null),
    mark as (select client_id, t from ck where crc % 5 = 0),
    ev as (select client_id, t, kind from ck union select client_id, t - 1000000, 'open' from mark union select client_id, t + 1000000, 'shut' from mark),
    e1 as (select client_id, kind as pattern, t, t begun from ev), {", ".join(_STEP.format(n=n, m=n - 1) for n in (2, 3, 4))},
    sp as ({" union all ".join(f"select distinct client_id, pattern, {n} as length from e{n}" for n in (1, 2, 3, 4))}),
    cl as (select client_id, {_CRC.format("client_id")} crc from (select distinct client_id from ev), tb),
    k4 as (select pattern, length, count(*) support, sum(crc)::bigint clients_crc, string_split(pattern, '>') w from sp join cl using (client_id) group by 1, 2 having count(*) >= 2 and count(*) * 10 >= (select count(*) from cl)),
    sb as (select s, support, count(*) n_wider from ({_SUB}) group by 1, 2)
    select pattern, length::int length, k4.support, clients_crc, coalesce(n_wider, 0) n_wider, n_wider is null closed from k4 left join sb on sb.s = pattern and sb.support = k4.support"""
