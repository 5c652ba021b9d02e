"""Streams of verses: words are pronounced by the batch's own links, verses scanned a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metrika.functions import phonology as P
from metrika.operators import g2p, scan, tokenize

PLACE = ["verse_id", "line", "word_idx", "form"]


def pronounced(verses: DataFrame, lexicon: DataFrame, slang: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, word, source, cost, prons of every word of verses, a table or a stream.

    All links of the chain are joins with the static dictionaries (broadcast if counted small), so
    a stream needs no state, and its words sound as those of a table do.
    """
    words = tokenize.tokenize_verse(verses).withColumnRenamed("word", "form").withColumn("word", F.lower("form"))
    out = g2p.voiced(g2p.chain(words, lexicon, slang, *PLACE), *PLACE)
    return out.drop("word").withColumnRenamed("form", "word")


def tails(verses: DataFrame, lexicon: DataFrame, slang: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, word, source, tail of every word: that of its first pronunciation; null without one."""
    first = F.get("prons", F.lit(0))
    return pronounced(verses, lexicon, slang).select(*PLACE[:3], "word", "source", P.syllables_text(P.rhyme_tail(first)).alias("tail"))


def scan_stream(verses: DataFrame, lexicon: DataFrame, slang: DataFrame, path: str, checkpoint: str, **knobs) -> StreamingQuery:
    """Scan each micro-batch's verses (a verse comes whole in one row) and write what is selected below path.

    A batch writes its own folder, batch=<its number>, and a batch that is run again replaces it: so
    the folders together hold every verse's selection once. The lexicon and slang are static.
    """

    def each(batch: DataFrame, number: int) -> None:
        scan.scan_verse(batch, lexicon, slang, **knobs).selected.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return verses.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
