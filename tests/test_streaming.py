"""Streams of verses give what tables of the same verses give."""

from metrika.operators import g2p, scan, tokenize
from metrika.sources import lexicon
from metrika.streaming import verses as stream
from pyspark.sql import functions as F

VERSES = [(1, "wakin' up, seein' the Coogi\nbrrr playa imma"), (2, "see me\nplane man\nsane man"), (3, ""), (4, None), (5, "wake up, take a cake and shake the state up")]
KIND = "verse_id long, text string"


def source_of(spark, path):
    spark.createDataFrame(VERSES, KIND).repartition(3).write.parquet(path)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_words_sound_alike_in_a_stream_and_a_table(spark, tmp_path):
    lex, slang = lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark)
    q = stream.tails(source_of(spark, str(tmp_path / "in")), lex, slang).writeStream.format("memory").queryName("sounds").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("sounds").fillna("", ["tail"]).collect())
    whole = spark.createDataFrame(VERSES, KIND)
    assert got == sorted(tuple(r) for r in stream.tails(whole, lex, slang).fillna("", ["tail"]).collect())
    tokens = tokenize.tokenize_verse(whole)
    sources = {r.word: r.source for r in g2p.pronounce(tokens.select("word"), lex, slang).collect()}
    assert {r[3].lower(): r[4] for r in got} == sources and {"g-drop", "stem+-in'", "lexicon", "letter-to-sound", "oov", "dictionary"} >= set(sources.values())
    assert len(set(sources.values())) >= 5


def test_scanned_stream_equals_scanned_table(spark, tmp_path):
    lex, slang = lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark)
    verses = source_of(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.scan_stream(verses, lex, slang, out, str(tmp_path / "check")).awaitTermination(300)
    got = spark.read.parquet(out).drop("batch")
    found = scan.scan_verse(spark.createDataFrame(VERSES, KIND), lex, slang)
    want = sorted(map(tuple, found.selected.collect()))
    assert sorted(map(tuple, got.select(found.selected.columns).collect())) == want and len(want) > 5
    # started again, it has nothing to do
    stream.scan_stream(verses, lex, slang, out, str(tmp_path / "check")).awaitTermination(300)
    assert spark.read.parquet(out).count() == len(want)
    assert spark.read.parquet(out).select(F.countDistinct("batch")).first()[0] >= 2
