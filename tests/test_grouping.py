"""Components, forests and rhyme groups against plain searches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import components, kernel, rhymes


def reached(nodes, edges):
    """node -> smallest node of its component."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def of(spark, nodes, edges, rounds=None):
    n = spark.createDataFrame([(0, x) for x in nodes], "scope int, node long")
    e = spark.createDataFrame([(0, a, b) for a, b in edges], "scope int, a long, b long")
    return {r.node: r.component for r in components.connected_components(n, e, rounds).collect()}


@pytest.mark.parametrize("seed", [0, 3])
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = list(range(60))
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(20 + 12 * seed)]
    assert of(spark, nodes, edges) == reached(nodes, edges)


def test_small_graphs(spark):
    assert of(spark, [0, 1, 2, 3, 4], [(0, 2), (2, 4)]) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0}
    assert of(spark, [3, 5], []) == {3: 3, 5: 5}
    assert of(spark, [1, 2], [(1, 1), (2, 1), (1, 2), (2, 1)]) == {1: 1, 2: 1}
    assert of(spark, [], []) == {}


def test_scopes_stay_apart(spark):
    nodes = spark.createDataFrame([(s, n) for s in "xy" for n in (1, 2, 3)], "scope string, node int")
    edges = spark.createDataFrame([("x", 1, 2), ("y", 3, 2)], "scope string, a int, b int")
    got = {(r.scope, r.node): r.component for r in components.connected_components(nodes, edges).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 3): 3, ("y", 1): 1, ("y", 2): 2, ("y", 3): 2}


def test_a_long_path_takes_few_rounds(spark):
    n, rounds = 100_000, []
    edges = spark.range(n - 1).select(F.lit(0).alias("scope"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.connected_components(spark.range(n).select(F.lit(0).alias("scope"), F.col("id").alias("node")), edges, rounds)
    assert found.agg(F.count("*"), F.max("component")).first() == (n, 0)
    assert len(rounds) <= 20  # log2(n) is 17


def test_a_large_star_takes_few_rounds(spark):
    n, rounds = 1_000_000, []
    hub = n // 2
    edges = spark.range(n).select(F.lit(0).alias("scope"), F.lit(hub).cast("long").alias("a"), F.col("id").alias("b"))
    found = components.connected_components(edges.select("scope", F.col("b").alias("node")), edges, rounds)
    assert found.agg(F.count("*"), F.max("component")).first() == (n, 0)
    assert len(rounds) <= 4


def test_a_hubs_rows_are_not_dealt_out(spark):
    rows = spark.createDataFrame([(0, 7, i) for i in range(500)] + [(0, i, i + 1) for i in range(20)], "scope int, u long, v long")
    found = components.with_least(rows, "u", "v", 520)
    assert {(r.u, r.m) for r in found.collect()} == {(7, 0), *((i, i + 1) for i in range(20) if i != 7)} and found.count() == 520
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(2))
def test_forest_links_what_all_edges_link_at_every_cut(spark, seed):
    r = random.Random(seed)
    rows = [(s, r.randrange(25), r.randrange(25), r.choice([0.5, 0.75, round(r.random(), 3)])) for s in (1, 2) for _ in range(60)]
    forest = [tuple(x) for x in components.spanning_forest(spark.createDataFrame(rows, "scope int, a long, b long, score double")).collect()]
    for s in (1, 2):
        own = [x for x in rows if x[0] == s]
        nodes = sorted({n for x in own for n in x[1:3]})
        for cut in sorted({x[3] for x in own}):
            whole = reached(nodes, [x[1:3] for x in own if x[3] >= cut])
            assert reached(nodes, [x[1:3] for x in forest if x[0] == s and x[3] >= cut]) == whole
        trees = len(set(reached(nodes, [x[1:3] for x in own]).values()))
        assert len([x for x in forest if x[0] == s]) == len(nodes) - trees


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([(1, 2, 2, 0.9), (1, 2, 3, None)], "scope int, a long, b long, score double")
    assert components.spanning_forest(none).collect() == []


def made_up_tails(seed, n):
    r = random.Random(seed)
    codas = [[], ["T"], ["N", "D"], ["S"], ["NG"], ["K", "S", "T"]]
    few = r.sample(T.VOWELS, 6)
    return [[([r.choice(["B", "K"])], r.choice(few), r.choice(codas), 1 if i == 0 else 0) for i in range(r.choice([1, 2, 2, 3, 3, 4, 5, 7]))] for _ in range(n)]


def tail_table(spark, tails):
    rows = spark.createDataFrame(list(enumerate(tails)), "id long, s array<struct<onset:array<string>,nucleus:string,coda:array<string>,stress:int>>")
    return components.settled(rows.select("id", kernel.coded(F.col("s")).alias("t")).dropDuplicates(["t"]))


def all_scores(tails):
    end = lambda c, t: tails.select(F.col("id").alias(c), F.col("t").alias(t))
    pairs = end("a", "t1").crossJoin(end("b", "t2")).where("a < b")
    return {(r.a, r.b): r.score for r in kernel.score_tails(pairs, "t1", "t2", path=False).select("a", "b", "score").collect()}


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.92])
def test_links_join_what_all_pairs_join(spark, threshold):
    tails = tail_table(spark, made_up_tails(int(threshold * 100), 160))
    scores = all_scores(tails)
    nodes = [r.id for r in tails.select("id").collect()]
    links = [tuple(sorted((r.a, r.b))) for r in rhymes.tail_links(tails, threshold).collect()]
    assert all(scores[p] >= threshold for p in links)
    assert reached(nodes, links) == reached(nodes, [p for p, x in scores.items() if x >= threshold])
    found = {tuple(sorted((r.a, r.b))): r.score for r in rhymes.rhyming_pairs(tails, tails, threshold).collect()}
    assert found == {p: x for p, x in scores.items() if x >= threshold}


def test_scores_in_arrays_equal_the_expression(spark):
    tails = tail_table(spark, made_up_tails(5, 120))
    scores = all_scores(tails)
    end = lambda c, t: tails.select(F.col("id").alias(c), F.col("t").alias(t))
    pairs = end("a", "t1").crossJoin(end("b", "t2")).where("a < b")
    got = {(r.a, r.b): r.score for r in rhymes.reaching(pairs, 1e-6).collect()}
    assert got == {p: x for p, x in scores.items() if x >= 1e-6}


def test_no_nested_loops(spark):
    tails = tail_table(spark, made_up_tails(1, 30))
    for df in (rhymes.rhyming_pairs(tails, tails, 0.75), rhymes.offers(tails.select("id", "t", F.col("id").alias("component"), F.lit(True).alias("open")), 0)):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_words_without_variants_and_above_all_scores(spark):
    one = [([], "AE", ["T"], 1)]
    kind = "word string, idx long, variants array<array<struct<onset:array<string>,nucleus:string,coda:array<string>,stress:int>>>"
    words = spark.createDataFrame([("cat", 1, [one]), ("hat", 2, [one]), ("brr", 3, []), ("zzz", 4, None), ("", 5, [[]])], kind)
    assert {r.word: r.component for r in components.group_rhymes(words).collect()} == {"cat": 1, "hat": 1, "brr": 3, "zzz": 4, "": 5}
    assert {r.component for r in components.group_rhymes(words, 1.5).collect()} == {1, 2, 3, 4, 5}
    assert components.group_rhymes(words.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_tail_groups_are_what_all_links_make(spark, seed):
    tails = tail_table(spark, made_up_tails(seed + 7, 80))
    ids = [r.id for r in tails.select("id").collect()]
    links = [(r.a, r.b) for r in rhymes.rhyming_pairs(tails, tails, 0.75).collect()]
    got = {}
    for r in rhymes.tail_groups(tails, 0.75).collect():
        got.setdefault(r.component, set()).add(r.id)
    want = {}
    for node, root in reached(ids, links).items():
        want.setdefault(root, set()).add(node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_first_offers_are_one_a_block(spark):
    tails = tail_table(spark, made_up_tails(5, 80)).select("id", "t", F.col("id").alias("component"), F.lit(True).alias("open"))
    made = [(r.a, r.b) for r in rhymes.offers(tails, 0).select("a", "b").collect()]
    keys = tails.select(F.size(rhymes.block_keys(F.col("t"))).alias("k")).agg(F.sum("k")).first()[0]
    assert 0 < len(made) == len(set(made)) <= keys and all(a > b for a, b in made)


def test_a_word_joins_the_groups_of_its_variants(spark):
    say = lambda *s: [{"onset": [], "nucleus": v, "coda": list(c), "stress": int(i == 0)} for i, (v, *c) in enumerate(s)]
    rows = [("d", 4, [say(("IY", "T"))]), ("c", 3, [say(("AA", "K")), say(("IY", "T"))]), ("b", 2, [say(("AA", "K"))]), ("a", 1, [say(("UW",))]), ("e", 5, [])]
    words = spark.createDataFrame(rows, f"word string, idx int, variants array<array<{P.SYLLABLE}>>")
    assert {r.word: r.component for r in components.group_rhymes(words).collect()} == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 5}


def test_codas_of_any_length():
    lists = [[[], [0], [23, 0], [0, 23]], [[0], [], list(range(11)), [23] * 12]]
    for more in ([], [[5] * 13, [5] * 14]):
        columns = [pa.array(x + more, pa.list_(pa.int32())) for x in lists]
        places, table = rhymes._codas(columns)
        plain = rhymes.coda_table([c for x in lists for c in x + more])
        at = np.concatenate(places)
        assert (table[at[:, None], at[None, :]] == plain).all()


def test_settled_tables_keep_few_partitions(spark):
    """A small table in rounds of unions has no more partitions than cores, whatever the shuffles'; a large one keeps its own."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        small = components.settled(spark.range(500).groupBy((F.col("id") % 50).alias("k")).count())
        both = components.settled(small.unionByName(small).unionByName(small))
        large = components.settled(spark.range(40 * components.ROWS).repartition(40, "id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    cores = spark.sparkContext.defaultParallelism
    assert small.rdd.getNumPartitions() <= cores and both.rdd.getNumPartitions() <= cores and both.count() == 150
    assert large.rdd.getNumPartitions() == 40


def coded_tails(r, n, syllables):
    kind = pa.list_(pa.struct([("v", pa.int32()), ("c", pa.list_(pa.int32())), ("w", pa.bool_())]))
    coda = lambda: [r.randrange(len(T.CONSONANTS)) for _ in range(r.randrange(9))]
    return pa.array([[{"v": r.randrange(len(T.VOWELS)), "c": coda(), "w": False} for _ in range(r.choice(syllables))] for _ in range(n)], kind)


def test_a_batch_of_different_codas_takes_little_memory():
    import tracemalloc

    r = random.Random(4)
    a, b = coded_tails(r, 1500, [2]), coded_tails(r, 1500, [2, 3])
    tracemalloc.start()
    rhymes._scores(a, b, 1.0, 0.35, 0.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # a table of all pairs of some 5,000 codas has 200 MB


def test_pairs_are_aligned_in_parts(monkeypatch):
    r = random.Random(6)
    a, b = coded_tails(r, 200, [0, 1, 2, 5]), coded_tails(r, 200, [0, 1, 3, 5])
    whole = rhymes._scores(a, b, 1.0, 0.35, 0.6)
    monkeypatch.setattr(rhymes, "SYLLABLES", 7)
    assert all((x == y).all() for x, y in zip(whole, rhymes._scores(a, b, 1.0, 0.35, 0.6), strict=True))


def test_first_offers_join_most_tails_of_one_syllable(spark):
    r = random.Random(8)
    tails = [[([], r.choice(["AE", "IY", "OW"]), [r.choice(T.CONSONANTS) for _ in range(r.randrange(2, 5))], 1)] for _ in range(400)]
    tails = tail_table(spark, tails)
    nodes = [x.id for x in tails.select("id").collect()]
    start = tails.select("id", "t", F.col("id").alias("component"), F.lit(True).alias("open"))
    links = [(x.a, x.b) for x in rhymes.reaching(rhymes.offers(start, 0), 0.75).select("a", "b").collect()]
    assert len(set(reached(nodes, links).values())) < 100


def test_look_ups_in_samples_lose_nothing(spark, monkeypatch):
    """With one round of offers, tails that stay open are looked up in samples as long as this helps, and then in all."""
    tails = tail_table(spark, made_up_tails(11, 120))
    ids = [r.id for r in tails.select("id").collect()]
    want = reached(ids, [(r.a, r.b) for r in rhymes.rhyming_pairs(tails, tails, 0.75).collect()])
    asked, whole = [], rhymes.looked_up
    monkeypatch.setattr(rhymes, "looked_up", lambda state, among, *more: [asked.append(among.count()), whole(state, among, *more)][1])
    for name, value in (("ROUNDS", 1), ("MOST_PAIRS", 0)):
        monkeypatch.setattr(rhymes, name, value)
    links = [(r.a, r.b) for r in rhymes.tail_links(tails, 0.75).collect()]
    assert len(asked) > 1 and asked[0] < asked[-1] == len(ids)
    assert reached(ids, links) == want
