"""Audits of the feature space: published log-odds matrices, ranks, rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrika.functions import tables as T
from metrika.operators.components import settled

# Log-odds of vowel pairs in rap rhymes (Hirjee and Brown 2009, table 1), row i from column i on.
VOWEL_LOG_ODDS = """
2.3 -3.3 -0.8 1.6 -1.7 -2.7 -7.2 -0.6 -3.9 -4.8 -3.9 -1.0 -1.7 -3.3 -3.9
2.1 -1.5 -6.6 -1.9 -3.3 -1.5 -3.4 -1.8 -2.0 -4.3 -4.6 -4.5 -3.7 -6.7
2.2 -1.2 -1.4 -1.4 -0.6 -0.2 -1.7 -0.3 -3.0 -1.0 -0.6 -0.9 -1.5
3.1 -1.0 -3.8 -6.5 -1.1 -3.9 -4.2 -6.3 -0.3 -0.4 1.1 -3.3
3.8 -0.3 -6.0 -4.2 -5.7 -6.0 -5.7 -2.0 -2.9 -4.5 -1.4
2.5 -4.2 -1.1 -7.0 -1.8 -3.2 -4.3 -1.1 -5.7 -6.4
1.9 -1.2 -1.5 0.2 -2.1 -7.0 -4.5 -6.1 -4.3
3.9 -5.6 -1.5 -5.5 -1.6 -2.7 -1.3 -2.6
2.5 -3.4 -2.7 -4.4 -4.3 -5.8 -6.5
2.0 -0.9 -7.1 0.2 -2.2 -3.7
2.4 -4.4 -4.2 -5.8 -6.4
2.8 -4.0 -2.5 -1.5
4.9 0.1 -3.7
2.6 -0.5
3.1
"""


def parse_matrix(spark: SparkSession, symbols: list[str], rows: str, extra: int = 0) -> DataFrame:
    """(a, b, log_odds), both ways round, of an upper triangle as text; `extra` columns at the end are checked and dropped."""
    lines = rows.strip().splitlines()
    n = len(symbols)
    if len(lines) != n or any(len(line.split()) != n + extra - i for i, line in enumerate(lines)):
        raise ValueError("the rows' lengths don't make an upper triangle of these symbols")
    names = F.array(*map(F.lit, symbols))
    text = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    cells = text.select("i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("k", "v")).where(F.col("i") + F.col("k") < n)
    upper = cells.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("i") + F.col("k")).alias("b"), F.col("v").cast("double").alias("log_odds"))
    return upper.unionByName(upper.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "log_odds"))


def distance_table(spark: SparkSession, symbols: list[str], distances: list[float]) -> DataFrame:
    """(a, b, distance, similarity) of all ordered pairs."""
    n = len(symbols)
    rows = [(symbols[i], symbols[j], distances[i * n + j], 1.0 - distances[i * n + j]) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "a string, b string, distance double, similarity double")


def pair_combinations(symbols: DataFrame) -> DataFrame:
    """(pair_idx, a, b): unordered pairs of (i, symbol), in order."""
    x, y = symbols.select(F.col("i").alias("i"), F.col("symbol").alias("a")), symbols.select(F.col("i").alias("j"), F.col("symbol").alias("b"))
    return x.join(y, F.col("i") < F.col("j")).withColumn("pair_idx", (F.row_number().over(Window.orderBy("i", "j")) - 1)).select("pair_idx", "a", "b")


SALTS = 16


def ranks(df: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """df with `name`: rank 1 for the largest, equal values sharing their mean rank; null for a null value. keys: ranks within these.

    Values are counted, sorted by ranges, and summed up range by range and inside each; no range
    has all rows, and no value's rows are dealt to one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    order = [*keys, F.desc(column)]
    placed = settled(counts.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    # what earlier ranges hold of the same keys; a row a range and key
    totals = placed.groupBy(*keys, "__part").agg(F.sum("__n").alias("__all"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        totals = totals.withColumn("__earlier", F.coalesce(F.sum("__all").over(earlier), F.lit(0)))
    else:
        sums, rows = 0, []
        for r in totals.orderBy("__part").collect():  # a row a range
            rows.append((r["__part"], sums))
            sums += r["__all"]
        totals = F.broadcast(spark.createDataFrame(rows, "__part int, __earlier long"))
    value = local.join(totals, [*keys, "__part"]).select(*keys, column, (F.col("__earlier") + F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    value = value.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(value, [*keys, column, "__salt"], "left").select(*df.columns, name)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho)."""
    both = ranks(ranks(df, a, "__ra"), b, "__rb")
    return both.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def rank_report(df: DataFrame, a: str, b: str, top: int = 10) -> DataFrame:
    """The `top` rows (pair_idx, a, b, ...) whose two ranks differ most, earlier pairs first among equals."""
    both = ranks(ranks(df, a, "rank_ours"), b, "rank_corpus").withColumn("gap", F.abs(F.col("rank_ours") - F.col("rank_corpus")))
    return both.orderBy(F.col("gap").desc(), "pair_idx").limit(top)


def vowel_audit(spark: SparkSession) -> DataFrame:
    """pair_idx, a, b, ours, corpus of the vowel pairs."""
    symbols = spark.createDataFrame(list(enumerate(T.VOWELS)), "i int, symbol string")
    ours = distance_table(spark, T.VOWELS, T.VOWEL_DISTANCES).select("a", "b", F.col("similarity").alias("ours"))
    corpus = parse_matrix(spark, T.VOWELS, VOWEL_LOG_ODDS).withColumnRenamed("log_odds", "corpus")
    return pair_combinations(symbols).join(ours, ["a", "b"]).join(corpus, ["a", "b"]).select("pair_idx", "a", "b", "ours", "corpus")


#: Place mismatches that should differ in weight: nasals against oral stops.
NASALS, ORALS = [("M", "N"), ("M", "NG"), ("N", "NG")], [("P", "T"), ("P", "K"), ("T", "K")]


def group_mean_check(spark: SparkSession) -> DataFrame:
    """nasal, oral (mean similarities) and whether nasal is clearly higher."""
    sims = distance_table(spark, T.CONSONANTS, T.CONSONANT_DISTANCES).select("a", "b", "similarity")
    rows = spark.createDataFrame([(k, a, b) for k, pairs in (("nasal", NASALS), ("oral", ORALS)) for a, b in pairs], "kind string, a string, b string")
    both = rows.join(sims, ["a", "b"]).agg(F.avg(F.when(F.col("kind") == "nasal", F.col("similarity"))).alias("nasal"), F.avg(F.when(F.col("kind") == "oral", F.col("similarity"))).alias("oral"))
    return both.withColumn("captured", F.col("nasal") > F.col("oral") + 0.05)


def log_odds(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n, log_odds), a <= b: how much oftener than by chance the symbols of pairs (a, b; either way round) stand in one column.

    The natural logarithm of a pair's share over the share that its symbols' own shares let expect.
    Pairs seen fewer than `least` times have no row.
    """
    seen = pairs.where("a is not null and b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    symbols = seen.select(F.col("a").alias("s"), "n").unionByName(seen.select(F.col("b").alias("s"), "n")).groupBy("s").agg(F.sum("n").alias("k"))
    total = seen.agg(F.sum("n").alias("total"))  # one row; symbols: a row a phoneme
    own = lambda c: F.broadcast(symbols.select(F.col("s").alias(c), F.col("k").alias(f"k_{c}")))
    both = seen.where(F.col("n") >= least).join(own("a"), "a").join(own("b"), "b").join(F.broadcast(total), F.lit(True))
    # a symbol's share is k / (2 * total); two different symbols may stand either way round
    chance = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("k_a") * F.col("k_b") / (4.0 * F.col("total"))
    return both.select("a", "b", "n", F.log(F.col("n") / chance).alias("log_odds"))


def learned_audit(pairs: DataFrame, symbols: list[str], distances: list[float], least: int = 1) -> DataFrame:
    """pair_idx, a, b, ours, corpus, n: similarities beside the log-odds of what stands in one column."""
    names = F.array(*map(F.lit, symbols))
    place = lambda c: F.array_position(names, F.col(c)).cast("int") - 1
    flat = F.array(*[F.lit(1.0 - d) for d in distances])
    rows = log_odds(pairs, least).withColumn("i", place("a")).withColumn("j", place("b"))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    n = len(symbols)
    # the pair's number among all pairs of different symbols, in the symbols' order
    idx = low * (2 * n - 3 - low) / 2 + high - 1
    return rows.where("i <> j").select(idx.cast("int").alias("pair_idx"), F.get(names, low).alias("a"), F.get(names, high).alias("b"), F.get(flat, low * n + high).alias("ours"), F.col("log_odds").alias("corpus"), "n")
