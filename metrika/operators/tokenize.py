"""Verses into lines, words and cells; positions are kept, blank lines too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every line break of the Unicode kind; a last break opens no further line.
BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
WORD = "[a-zA-Z']+"


def lines_of(text: Column) -> Column:
    parts = F.split(text, BREAK, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def verse_lines(verses: DataFrame) -> DataFrame:
    """verse_id, line, raw: a row a line."""
    return verses.select("verse_id", F.posexplode(lines_of(F.col("text"))).alias("line", "raw"))


def words_of(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(f"({WORD})"), 1)


def tokenize_verse(verses: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, word: runs of letters and apostrophes, in their case."""
    return verse_lines(verses).select("verse_id", "line", F.posexplode(words_of(F.col("raw"))).alias("word_idx", "word"))


def verse_cells(verses: DataFrame) -> DataFrame:
    """verse_id, line, cell_idx, text, is_word: words and what is between; together they are the line."""
    cells = F.regexp_extract_all("raw", F.lit(f"({WORD}|[^a-zA-Z']+)"), 1)
    out = verse_lines(verses).select("verse_id", "line", F.posexplode(cells).alias("cell_idx", "text"))
    return out.withColumn("is_word", F.col("text").rlike("^[a-zA-Z']"))
