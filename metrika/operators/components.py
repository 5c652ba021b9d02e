"""Connected components and spanning forests of edge tables, in rounds of joins; rhyme groups of a vocabulary."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="metrika-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows for which a settled table has a partition of its own, once there is one a core.
ROWS = 2000


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: short lineage that survives lost executors.

    A small table doesn't keep the partitions of the shuffles and unions that it came from, as
    each later round would have a task for each of them.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    # a checkpoint alone would compute df twice
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    most = max(spark.sparkContext.defaultParallelism, kept.count() // ROWS + 1)
    out = (kept.coalesce(most) if most < kept.rdd.getNumPartitions() else kept).checkpoint()
    kept.unpersist()
    return out


#: A node that has more than this share of all edges is joined by broadcast; there can be no more than 2 * HUBS of them.
HUBS = 1000


def with_least(rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """rows (scope, key, other; 2 * n at most) with m, the least `other` of a key; a hub's rows stay where they are."""
    least = rows.groupBy("scope", key).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    hub = F.col("n") * HUBS > n
    hubs = F.broadcast(least.where(hub).select("scope", key, F.col("m").alias("hub_m")))  # 2 * HUBS rows at most
    placed = rows.join(hubs, ["scope", key], "left")
    rest = placed.where("hub_m is null").drop("hub_m").join(least.where(~hub).drop("n"), ["scope", key])
    return placed.where("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


def _star_round(edges: DataFrame, n: int) -> DataFrame:
    """n edges (scope, hi, lo) with a large star and then a small star made at each node."""
    both = edges.select("scope", F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select("scope", F.col("lo").alias("u"), F.col("hi").alias("v")))
    # larger neighbours go to the least node near u, or to u
    large = with_least(both, "u", "v", n).where("v > u").select("scope", F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
    large = settled(large.distinct())
    # smaller neighbours go to the least of them, and the node too
    small = with_least(large, "hi", "lo", n)
    moved = small.where("lo <> m").select("scope", F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return settled(moved.unionByName(small.select("scope", "hi", F.col("m").alias("lo"))).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(scope, node, component): the smallest node that is reached; isolated nodes too.

    nodes: scope, node (any type with an order); edges: scope, a, b, inside one scope (a verse, a
    threshold). Rounds of large and small stars until every node hangs on its component's smallest;
    there are about as many as the logarithm of the longest path, each checkpointed, so that lineage
    stays short and survives lost executors. A hub's edges are never dealt out by the hub.
    rounds: a list that gets the edges of each round.
    """
    a, b = F.col("a"), F.col("b")
    kept = settled(edges.where("a <> b").select("scope", F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("scope", "hi", "lo")), F.sum(F.hash("scope", "hi", "lo").cast("long"))).first())
    state = mark(kept)
    while state[0]:
        new = _star_round(kept, state[0])
        old, state = state, mark(new)
        if rounds is not None:
            rounds.append(state[0])
        kept = new
        if state == old:
            break
    stars = kept.select("scope", F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.select("scope", "node").distinct().join(stars, ["scope", "node"], "left").select("scope", "node", F.coalesce("component", "node").alias("component"))


def spanning_forest(scores: DataFrame) -> DataFrame:
    """(scope, a, b, score): a maximum spanning forest of scores (scope, a, b, score), by the rounds of Boruvka.

    At every threshold the forest's edges that reach it link the same nodes as all edges that
    do, so a cut is a filter. Among equal scores the smaller edge goes first. In each round every
    tree takes its best edge to another; of parallel edges between two trees only the best stays.
    """
    # a < b; the order of edges is total, so that no ring can close
    edges = scores.where("a <> b and score is not null").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    edges = edges.groupBy("scope", "a", "b").agg(F.max("score").alias("score"))
    edges = settled(edges.select("scope", F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("score")).alias("cost"), "a", "b").alias("e")))
    forest = None
    while not edges.isEmpty():
        ends = edges.select("scope", F.col("x").alias("tree"), "e").unionByName(edges.select("scope", F.col("y").alias("tree"), "e"))
        best = ends.groupBy("scope", "tree").agg(F.min("e").alias("e"))
        chosen = settled(best.select("scope", "e").distinct().join(edges, ["scope", "e"]))
        own = chosen.select("scope", "e.a", "e.b", (-F.col("e.cost")).alias("score"))
        forest = own if forest is None else forest.unionByName(own)
        trees = ends.select("scope", F.col("tree").alias("node"))
        label = settled(connected_components(trees, chosen.select("scope", F.col("x").alias("a"), F.col("y").alias("b"))))
        to = lambda c: label.select("scope", F.col("node").alias(c), F.col("component").alias(f"{c}2"))
        moved = edges.join(to("x"), ["scope", "x"]).join(to("y"), ["scope", "y"]).where("x2 <> y2")
        moved = moved.select("scope", F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y"), "e")
        edges = settled(moved.groupBy("scope", "x", "y").agg(F.min("e").alias("e")))
    return scores.select("scope", "a", "b", "score").limit(0) if forest is None else settled(forest)


def group_by_threshold(nodes: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Components of the scores (scope, a, b, score) that reach the threshold."""
    return connected_components(nodes, scores.where(F.round("score", 9) >= threshold))


def group_rhymes(words: DataFrame, threshold: float = 0.75, **weights) -> DataFrame:
    """(word, idx, component): words that rhyme, over all pairs and the best of their variants; a word without variants is alone.

    words: word, idx (its place), variants. Distinct tails are grouped by rhymes.tail_groups(),
    which compares no pairs inside a group; a word belongs to its tail's group, and one with
    tails of several groups joins them.
    """
    from metrika.functions import phonology as P
    from metrika.operators import kernel, rhymes

    if threshold > 1:  # equal tails score 1
        return words.select("word", "idx", F.col("idx").alias("component"))
    tails = words.select("idx", F.explode("variants").alias("v")).select("idx", kernel.coded(P.rhyme_tail(F.col("v"))).alias("t")).where(F.size("t") > 0)
    tails = settled(tails)
    heads = settled(tails.groupBy("t").agg(F.min("idx").alias("head")).withColumn("id", F.monotonically_increasing_id()))
    groups = rhymes.tail_groups(heads.select("id", "t"), threshold, **weights)
    own = settled(tails.join(heads.select("t", "id"), "t").join(groups, "id").select("idx", F.col("component").alias("node")).distinct())
    least = own.groupBy("idx").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("idx", "a")
    scope = F.lit(0).alias("scope")
    across = own.join(least, "idx").select(scope, "a", F.col("node").alias("b"))
    label = connected_components(groups.select(scope, F.col("component").alias("node")), across).select("node", F.col("component").alias("label"))
    first = heads.select("id", "head").join(groups.select("id", F.col("component").alias("node")), "id").join(label, "node")
    first = first.groupBy("label").agg(F.min("head").alias("component"))
    found = own.groupBy("idx").agg(F.min("node").alias("node")).join(label.join(first, "label").select("node", "component"), "node")
    return words.select("word", "idx").join(found.select("idx", "component"), "idx", "left").select("word", "idx", F.coalesce("component", "idx").alias("component"))
