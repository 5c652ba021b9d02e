"""Gold annotations as text: groups of word references and vetoed pairs.

    verse:
    <the verse's lines>

    group: text@L.W text@L.W-W2 ...
    not: text@L.W text@L.W

Lines and words count from 1 in the text, from 0 in the table (kind, gid, ref_idx, text, line, w1, w2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFERENCE = r"([^@\s][^@]*?)@(\d+)\.(\d+)(?:-(\d+))?(?=\s|$)"


def parse_annotations(df: DataFrame) -> DataFrame:
    """df (verse_id, annotation) into rows; lines of neither kind are left out."""
    lines = df.select("verse_id", F.posexplode(F.split("annotation", "\n")).alias("gid", "line_text"))
    lines = lines.withColumn("kind", F.regexp_extract("line_text", r"^(group|not): ", 1)).where("kind <> ''")
    rest = F.regexp_replace("line_text", r"^(group|not): ", "")
    cut = lambda k: F.regexp_extract_all(rest, F.lit(REFERENCE), k)
    refs = F.arrays_zip(*[cut(k).alias(n) for k, n in ((1, "t"), (2, "l"), (3, "a"), (4, "b"))])
    out = lines.select("verse_id", "kind", "gid", F.posexplode(refs).alias("ref_idx", "r"))
    w1 = F.col("r.a").cast("int") - 1
    return out.select("verse_id", "kind", "gid", "ref_idx", F.trim("r.t").alias("text"), (F.col("r.l").cast("int") - 1).alias("line"), w1.alias("w1"), F.when(F.col("r.b") == "", w1).otherwise(F.col("r.b").cast("int") - 1).alias("w2"))


def write_annotations(verses: DataFrame, refs: DataFrame) -> DataFrame:
    """verse_id, annotation: groups of two references or more, then vetoes."""
    place = F.concat(F.col("line") + 1, F.lit("."), F.col("w1") + 1, F.when(F.col("w2") > F.col("w1"), F.concat(F.lit("-"), F.col("w2") + 1)).otherwise(""))
    one = refs.select("verse_id", "kind", "gid", "ref_idx", F.concat("text", F.lit("@"), place).alias("ref"))
    rows = one.groupBy("verse_id", "kind", "gid").agg(F.array_sort(F.collect_list(F.struct("ref_idx", "ref"))).alias("r")).where("kind = 'not' or size(r) >= 2")
    text = F.concat("kind", F.lit(": "), F.array_join(F.transform("r", lambda x: x["ref"]), " "))
    lines = rows.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("kind", "gid", text.alias("t")))).alias("all"))
    out = verses.join(lines, "verse_id", "left")
    body = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<kind:string,gid:int,t:string>>")), lambda x: x["t"]), "\n")
    return out.select("verse_id", F.concat(F.lit("verse:\n"), "text", F.lit("\n\n"), body).alias("annotation"))
