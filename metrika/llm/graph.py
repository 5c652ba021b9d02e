"""Connected components by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of the component, for every node of an edge.

    Each round a node takes the smallest label among its neighbours', then its label's label;
    the state is written to the shared folder, so a round's lineage is short.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(both.select("other", "node")).where("node <> other").distinct()
    both = stored(spark, both, "edges")
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        old = stored(spark, labels, "labels")
        near = both.join(old.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        best = old.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        best = stored(spark, best, "labels")
        jump = best.join(best.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        # min over all that point to a label: a root hears of smaller labels that its members found
        root = best.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("heard"))
        labels = jump.join(root, "node", "left").select("node", F.least("label", "next", F.coalesce("heard", "next")).alias("label"))
        if not best.where("was <> label").limit(1).count():
            return old
