"""Sequential patterns against all choices of events, in blocks of every size, and odd tables."""

import itertools
import random
import zlib

import numpy as np
import pytest

from metrika.llm import event_patterns as E

GAP, SPAN = 600, 1200


def brute(events, max_length=4):
    """client -> its patterns, by trying all choices of events."""
    out = {}
    for client in {c for c, _, _ in events}:
        own = sorted({(t, k) for c, t, k in events if c == client})
        found = out.setdefault(client, set())
        for n in range(1, max_length + 1):
            for chosen in itertools.combinations(own, n):
                steps = [b[0] - a[0] for a, b in zip(chosen, chosen[1:])]
                if all(0 < s <= GAP for s in steps) and chosen[-1][0] - chosen[0][0] <= SPAN:
                    found.add(tuple(k for _, k in chosen))
    return out


def some_events(seed, clients=5, n=60):
    r = random.Random(seed)
    return [(r.randrange(clients), r.choice([r.randrange(4000), r.randrange(40) * 100]), r.choice("abc")) for _ in range(n)]


def coded(values):
    names = list(dict.fromkeys(values))
    return names, np.array([names.index(v) for v in values])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_supports_in_blocks_equal_all_choices(seed, block):
    events = some_events(seed)
    want = brute(events)
    rows = sorted({(c, t - t % 3000, t, k) for c, t, k in events} | {(c, t - t % 3000 - 3000, t, k) for c, t, k in events if t % 3000 < SPAN})
    counts, at = E.Counts(GAP, SPAN, 4), 0
    while at < len(rows):
        end = at + block
        while end < len(rows) and rows[end][:3] == rows[end - 1][:3]:  # one time stays in one block
            end += 1
        own = rows[at:end]
        counts.add(coded([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own]), coded([r[3] for r in own]))
        at = end
    supports, crcs = {}, {}
    for types, client, n, crc in counts.rows():
        key = tuple(types)
        supports[key] = supports.get(key, 0) + (n or 1)
        crcs[key] = crcs.get(key, 0) + (crc if client is None else zlib.crc32(str(client).encode()))
    for p in {p for found in want.values() for p in found}:
        own = [c for c, found in want.items() if p in found]
        assert supports.pop(p) == len(own)
        assert crcs[p] == sum(zlib.crc32(str(c).encode()) for c in own)
    assert not supports


def test_mine_over_partitions(spark):
    events = some_events(9, clients=3, n=90)
    want = brute(events, 3)
    got = E.mine(spark, spark.createDataFrame(events, "client_id long, t long, kind string"), 3, GAP, SPAN, 2, 10).collect()
    kept = {p: sum(p in f for f in want.values()) for p in {p for f in want.values() for p in f}}
    assert {tuple(r.types): r.support for r in got} == {p: n for p, n in kept.items() if n >= 2}


def test_wider_patterns(spark):
    rows = [(["a"], 3, 0), (["a", "b"], 3, 0), (["a", "b", "a"], 3, 0), (["b"], 4, 0), (["b", "b"], 3, 0)]
    got = {tuple(r.types): (r.n_wider, r.closed) for r in E.with_wider(spark, spark.createDataFrame(rows, "types array<string>, support long, clients_crc long")).collect()}
    assert got == {("a",): (2, False), ("a", "b"): (1, False), ("a", "b", "a"): (0, True), ("b",): (0, True), ("b", "b"): (0, True)}


def test_rare_types_and_bounds(spark):
    rows = [(c, t, k) for c in range(4) for t, k in ((0, "x"), (600, "y"), (1200, "x"), (1801, "y"))] + [(0, 5, "rare"), (1, 7, "")]
    got = {tuple(r.types): r.support for r in E.mine(spark, spark.createDataFrame(rows, "client_id int, t long, kind string"), 3, GAP, SPAN, 2, 10).collect()}
    assert got == {("x",): 4, ("y",): 4, ("x", "y"): 4, ("y", "x"): 4, ("x", "y", "x"): 4}


@pytest.mark.parametrize("rows", [[], [(None, 1, "a"), (1, None, "a"), (1, 1, None)]])
def test_nothing_to_mine(spark, rows):
    events = spark.createDataFrame(rows, "client_id long, t long, kind string")
    assert E.with_wider(spark, E.mine(spark, events)).collect() == []


def test_clients_are_texts_and_columns_clash(spark):
    rows = [("é", 1, "a", "x"), ("é", 1, "a", "y"), ("q", 2, "a", "z")]
    got = E.mine(spark, spark.createDataFrame(rows, "client_id string, t long, kind string, CHUNK string")).collect()
    assert [(r.types, r.support, r.clients_crc) for r in got] == [(["a"], 2, zlib.crc32("é".encode()) + zlib.crc32(b"q"))]


def test_click_events(spark):
    rows = spark.sql("select 35L click_id, timestamp_ntz'2024-03-10 02:30:00.5' ts, 7L client_id, 'view' kind union all select null, timestamp_ntz'1970-01-01 00:00:01', 7L, 'view' union all select 1L, null, 7L, 'x'")
    got = sorted((r.t, r.kind) for r in E.click_events(rows).collect())
    t = 1710037800500000
    near = [(t - 1_000_000, "open"), (t, "view"), (t + 1_000_000, "shut")] if zlib.crc32(b"35") % 5 == 0 else [(t, "view")]
    assert got == [(1_000_000, "view"), *near]


def test_registered_query_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(3)
    path = str(tmp_path / "clicks.parquet")
    con = duckdb.connect()
    con.execute("create table c (click_id bigint, ts timestamp, arrived_at timestamp, client_id bigint, kind varchar, value double, props varchar)")
    for i in range(300):
        con.execute("insert into c values (?, make_timestamp(?::bigint), null, ?, ?, null, null)", [i, r.randrange(8_000_000_000), r.randrange(5), r.choice(["view", "buy", None])])
    con.execute(f"copy c to '{path}' (format parquet)")
    con.execute(f"create view clicks as select * from '{path}'")
    got = sorted(map(tuple, E.query(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(E.ORACLE).fetchall()) and len(got) > 100
