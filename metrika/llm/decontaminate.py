"""Benchmark decontamination by size-partitioned MinHash containment search; built-in functions only.

An item is contained in a document if the document has at least 80 % of its distinct shingles
(five lower-cased words; the whole sequence if there are fewer). Items fall into partitions
by size (powers of two); an item's sketch is its shingles of smallest hash, as many as make
it sure that one of them is in every document that contains the item: with n shingles at
most n - ceil(0.8 n) are missing, so the smallest n - ceil(0.8 n) + 1 suffice and no
containment is missed. A document is probed by the partitions whose items it is long enough
for. To find sketches inside long documents without hashing all their shingles, each sketch
shingle is looked up by its longest word, then compared in full. What is found is verified
by counting exact shingles in the found documents alone.

The sketch table and the found documents' keys are broadcast if their bytes are counted to be
within BROADCAST, else joined by shuffle. Defined cases: null or empty text and items
without words are never contained; an item of fewer than five words is one shingle, which
only documents of just those words have; the texts of a repeated item_id are one item with
the shingles of all, while each text without an id is an item of its own; rows of equal id
and text come out once; null ids are kept as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BROADCAST = 32 << 20  # bytes
SHINGLE = 5
PERCENT = 80


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles(of: Column, size: int = SHINGLE) -> Column:
    """All shingles of an array of words, in order."""
    n = F.size(of)
    several = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(of, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(of, " "))).otherwise(several)


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """df, marked for broadcast if its rows have at most `limit` bytes."""
    sizes = [F.coalesce(F.length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes]
    return F.broadcast(df) if (df.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0) <= limit else df


def item_shingles(items: DataFrame, text: str = "text") -> DataFrame:
    """no, item, n (distinct shingles), shingle: a row for each distinct shingle of an item; no: its key."""
    # the words are a column of their own, so that lambdas don't split the text anew for each shingle
    own = items.select(F.col("item_id").alias("item"), words(F.col(f"`{text}`")).alias("w"))
    no = F.when(F.col("item").isNotNull(), F.concat(F.lit("id "), F.col("item").cast("string"))).otherwise(F.concat(F.lit("text "), F.sha2(F.array_join("w", " "), 256)))
    rows = own.select(no.alias("no"), "item", F.explode(F.array_distinct(shingles(F.col("w")))).alias("shingle")).distinct()
    sizes = rows.groupBy("no").agg(F.count("*").alias("n"))
    return rows.join(sizes, "no").select("no", "item", "n", "shingle")


def sketches(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """no, n, part (size partition), shingle, width (its words), anchor (its longest word) and where that is."""
    by_item = rows.groupBy("no", "n").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("shingle").alias("h"), "shingle"))).alias("all"))
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    own = by_item.select("no", "n", F.explode(F.slice("all", 1, size.cast("int"))).alias("s")).select("no", "n", F.col("s.shingle").alias("shingle"))
    parts = F.split("shingle", " ")
    at = F.array_max(F.transform(parts, lambda w, i: F.struct(F.length(w).alias("l"), -i.cast("int"))))
    own = own.withColumn("width", F.size(parts)).withColumn("at", -at["col2"]).withColumn("part", F.floor(F.log2("n")).cast("int"))
    return own.withColumn("anchor", F.xxhash64(F.element_at(F.split("shingle", " "), F.col("at") + 1)))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the text) and text."""
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(own, F.length(own)).alias("key"), own.alias("text"))


def search(docs: DataFrame, sketch: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, no): texts that have a shingle of an item's sketch and are long enough for its partition."""
    own = keyed(docs, text).select("key", words(F.col("text")).alias("w"))
    # a document of m words has at most m shingles, so items of partitions from 2^p > m / 0.8 on can't be in it
    probes = own.select("key", "w", F.posexplode("w").alias("pos", "word")).select("key", "w", "pos", F.xxhash64("word").alias("h"))
    side = small(sketch.select("no", "part", "shingle", "width", "at", "anchor"))
    found = probes.join(side, F.col("h") == F.col("anchor"))
    found = found.where(F.size("w") * 100 >= F.pow(F.lit(2), F.col("part")) * percent)
    begin = F.col("pos") - F.col("at") + 1
    same = F.when(begin >= 1, F.array_join(F.slice("w", F.greatest(begin, F.lit(1)), F.col("width")), " ") == F.col("shingle"))
    return found.where(same).select("key", "no").distinct()


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, key, item, shared and n of every contained item; key stands for the text."""
    rows = stored(spark, item_shingles(items), "items")
    found = stored(spark, search(docs, sketches(rows, percent), text, percent), "found")
    keys = small(found.select("key").distinct())
    kept = keyed(docs, text).join(keys, "key", "left_semi")
    own = kept.select("doc_id", "key", words(F.col("text")).alias("w")).select("doc_id", "key", F.explode(F.array_distinct(shingles(F.col("w")))).alias("shingle"))
    pairs = own.join(small(rows), "shingle").join(found, ["key", "no"], "left_semi")
    counted = pairs.groupBy("doc_id", "key", "no", "item", "n").agg(F.countDistinct("shingle").alias("shared"))
    return counted.where(F.col("shared") * 100 >= F.col("n") * percent).select("doc_id", "key", "item", "shared", "n")


def filter_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that contain an item, by doc_id and text; the columns stay."""
    bad = contained(spark, docs, items, text).select(F.col("doc_id").alias("__id"), F.col("key").alias("__bad")).distinct()
    bad = stored(spark, bad, "contaminated")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    same = (F.col("__key") == F.col("__bad")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.withColumn("__key", F.xxhash64(own, F.length(own))).join(small(bad), same, "left_anti").drop("__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("item").alias("item_id"), "shared", F.col("n").alias("n_item"))


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
d as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end) s from w where len(w) > 0),
v as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark),
i as (select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end) s from v where len(w) > 0),
n as (select item_id, count(*) n_item from i group by 1)
select doc_id, item_id, count(*)::bigint shared, any_value(n_item)::bigint n_item
from d join i using (s) join n using (item_id) group by doc_id, item_id having count(*) * 100 >= any_value(n_item) * 80
"""
