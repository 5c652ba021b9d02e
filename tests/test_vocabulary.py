"""Ranks, log-odds, span readings, line ends and long lines against plain computations."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metrika.functions import tables as T
from metrika.operators import audit, g2p, kernel, scan, tokenize
from metrika.plans import catalogue, vocabulary
from metrika.sources import lexicon


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_share_ties_and_cross_ranges(spark, keys):
    r = random.Random(1)
    rows = [(i, r.choice("xyz"), r.choice([1.0, 1.0, 1.0, r.random(), -2.5, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    got = {x.i: x.rank for x in audit.ranks(df.repartition(5), "v", "rank", *keys).collect()}
    want = pd.DataFrame(rows, columns=["i", "k", "v"])
    want["rank"] = (want.groupby("k")["v"] if keys else want["v"]).rank(ascending=False, method="average")
    assert len(got) == 400
    assert all((math.isnan(w) and got[i] is None) or got[i] == w for i, w in zip(want["i"], want["rank"]))


def test_ranks_have_no_window_over_all_rows(spark):
    plan = audit.ranks(spark.range(100), "id", "rank")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_ranks_of_nothing(spark):
    assert audit.ranks(spark.range(0), "id", "rank").collect() == []


def test_log_odds_by_hand(spark):
    pairs = [("AA", "AE")] * 3 + [("AE", "AA")] + [("AA", "AA")] * 4 + [("AE", "AE"), ("IY", "IY"), (None, "AA")]
    got = {(r.a, r.b): (r.n, r.log_odds) for r in audit.log_odds(spark.createDataFrame(pairs, "a string, b string")).collect()}
    share = {"AA": 12 / 20, "AE": 6 / 20, "IY": 2 / 20}
    want = {("AA", "AE"): (4, 2), ("AA", "AA"): (4, 1), ("AE", "AE"): (1, 1), ("IY", "IY"): (1, 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - math.log(n / 10 / (ways * share[k[0]] * share[k[1]]))) < 1e-12 for k, (n, ways) in want.items())
    audited = audit.learned_audit(spark.createDataFrame(pairs, "a string, b string"), T.VOWELS, T.VOWEL_DISTANCES).collect()
    assert [(r.pair_idx, r.a, r.b, r.n) for r in audited] == [(0, "AA", "AE", 4)]


def test_pair_numbers_follow_the_symbols_order(spark):
    n = len(T.CONSONANTS)
    pairs = [(T.CONSONANTS[j], T.CONSONANTS[i]) for i in range(n) for j in range(i, n)]
    got = sorted((r.pair_idx, r.a, r.b) for r in audit.learned_audit(spark.createDataFrame(pairs, "a string, b string"), T.CONSONANTS, T.CONSONANT_DISTANCES).collect())
    want = [(T.CONSONANTS[i], T.CONSONANTS[j]) for i in range(n) for j in range(i + 1, n)]
    assert got == [(k, *p) for k, p in enumerate(want)]


def test_columns_of_an_alignment(spark):
    syllable = lambda v, *c: {"v": T.VOWELS.index(v), "c": [T.CONSONANTS.index(x) for x in c], "w": False}
    kind = "array<struct<v:int,c:array<int>,w:boolean>>"
    rows = spark.createDataFrame([([syllable("IH", "T"), syllable("AY", "N", "D")], [syllable("AY", "N", "T", "S")])], f"a {kind}, b {kind}")
    got = sorted((r.kind, r.a, r.b) for r in vocabulary.aligned_symbols(kernel.score_tails(rows, "a", "b")).collect())
    assert got == [("consonant", "D", "T"), ("consonant", "N", "N"), ("vowel", "AY", "AY")]


def test_combinations_are_numbered_like_nested_loops(spark):
    rows = [("a", i, [f"P{i}", "IY1"]) for i in range(2)] + [("b", i, [f"T{i}", "AA1"]) for i in range(3)] + [("c", 0, ["K", "OW1"])]
    lex = spark.createDataFrame(rows, "word string, variant_idx int, phones array<string>")
    spans = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "b"]), (3, ["a", "none"]), (4, ["c"])], "span_id int, words array<string>")
    got = {}
    for r in g2p.pronunciations_for_span(spans, lex).collect():
        got.setdefault(r.span_id, {})[r.variant_idx] = r.pronunciation.text
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(6)), 2: list(range(9)), 4: [0]}
    assert set(got[1].values()) == {"a b c"} and set(got[2].values()) == {"b b"}
    one = {r.variant_idx: [s.onset for s in r.pronunciation.syllables] for r in g2p.pronunciations_for_span(spans.where("span_id = 2"), lex).collect()}
    assert [one[k] for k in range(9)] == [[[f"T{i}"], [f"T{j}"]] for i in range(3) for j in range(3)]


def test_line_ends(spark):
    text = "the Cat\n\nsat on a hat,\nno rhyme here\n...\ncat"
    rows = spark.createDataFrame([(1, text), (2, "one\ntwo"), (3, None), (4, "")], "verse_id long, text string")
    got = {(r.w1, r.w2) for r in vocabulary.line_ends(rows).collect()}
    lines = ["cat", None, "hat", "here", None, "cat"]
    want = {tuple(sorted((a, b))) for i, a in enumerate(lines) for b in lines[i + 1 : i + 3] if a and b and a != b} | {("one", "two")}
    assert got == want


def test_pairs_near_each_other_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 4)
    r = random.Random(2)
    rows = [(v, line, start, n, 0) for v in (1, 2) for line in (0, 1, 3, 6) for start in range(r.choice([3, 11, 18])) for n in (1, 3)]
    df = spark.createDataFrame(rows, "verse_id long, line int, start int, n_words int, anchor int")
    got = [tuple(x) for x in scan.near(df, df, 2).select("verse_id", *[f"{s}_{c}" for s in "ab" for c in ("line", "start", "n_words")]).collect()]
    want = [(a[0], *a[1:4], *b[1:4]) for a in rows for b in rows if a[0] == b[0] and b[1] <= a[1] + 2 and (b[1] > a[1] or b[1] == a[1] and b[2] >= a[2] + a[3])]
    assert sorted(got) == sorted(want)


def test_a_long_line_is_scanned_as_its_parts_say(spark):
    """A line of 600 words: its words' matches are those of all pairs of its distinct words."""
    r = random.Random(5)
    words = [r.choice(["wake", "state", "see", "me", "great", "cat", "hat", "time", "rhyme", "brrr"]) for _ in range(600)]
    lex, slang = lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark)
    one = scan.scan_verse(spark.createDataFrame([(1, " ".join(words))], "verse_id long, text string"), lex, slang, max_span_words=1)
    got = one.matches.groupBy("a_words", "b_words").agg(F.count("*").alias("n")).collect()
    distinct = sorted(set(words))
    both = scan.scan_verse(spark.createDataFrame([(1, "\n".join([" ".join(distinct)] * 2))], "verse_id long, text string"), lex, slang, max_span_words=1)
    rhyming = {(x.a_words, x.b_words) for x in both.matches.collect()}
    places = {w: [i for i, x in enumerate(words) if x == w] for w in distinct}
    anchors = {(x.a_words, x.b_words): x.k for x in both.matches.where("a_line = 0 and b_line = 1").groupBy("a_words", "b_words").agg(F.count("*").alias("k")).collect()}
    want = {(a, b): sum(j > i for i in places[a] for j in places[b]) * anchors[a, b] for a, b in rhyming}
    assert {(x.a_words, x.b_words): x.n for x in got} == want and len(want) > 5
    plan = scan.span_ngrams(spark.createDataFrame([(1, 0, 0, "a")], "verse_id long, line int, word_idx int, word string"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_guesses_are_made_once_and_in_many_tasks(spark, tmp_path):
    spark.createDataFrame([(1, "Brrr, a cat\nwho's who", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["g2p_letter_to_sound"](spark, str(tmp_path))
    assert {r.word: r.phones for r in df.collect()} == {"a": "AE1", "cat": "K AE1 T", "who": "W AA1", "who's": "W AA1 S"}
    plan = catalogue.QUERIES["g2p_letter_to_sound"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("igh|tch") <= 1


def test_what_can_be_guessed_is_what_has_phones(spark):
    r = random.Random(3)
    words = ["y", "i", "quy", "qu", "yy", "y'", "brr", "", "'", "x1", "naïve", "be", "ice", None] + ["".join(r.choice("aeiouyqcghtwr'") for _ in range(r.randrange(1, 6))) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.coalesce(g2p.can_be_guessed(F.col("w")), F.lit(False)).alias("can"), g2p.letter_to_sound(F.col("w")).isNotNull().alias("does"))
    assert df.where("can <> does").collect() == []


def test_provenance_inside_rows(spark):
    rows = [(1, "The Coogi brrr\ncoogi Thinkin' thinkin'"), (2, "cat sofa"), (2, "Sofa xx\nday xX"), (3, None), (4, ""), (None, "gas xx"), (None, "Xx gas")]
    table = spark.createDataFrame(rows, "verse_id long, text string")
    dictionaries = lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark)
    tokens = tokenize.tokenize_verse(table)
    want = g2p.word_provenance(tokens, g2p.pronounce(tokens.select("word"), *dictionaries)).collect()
    found = g2p.provenance(table, *dictionaries)
    assert sorted(map(str, found.select("verse_id", "word", "source", "line", "word_idx").collect())) == sorted(map(str, want))
    plan = g2p.provenance(table.where("verse_id is not null"), *dictionaries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [verse_id") <= 3  # ids that come again (in both branches), and the words of these


def test_readings_of_pairs_are_numbered_as_combinations(spark):
    lists = spark.createDataFrame([("a", ["p", "q"]), ("b", ["x", "y", "z"]), ("c", ["k"])], "word string, v array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "a"), ("a", "none")], "w1 string, w2 string")
    got = sorted(tuple(r) for r in g2p.pair_readings(pairs, lists).collect())
    assert [(r[2], r[3] + r[4]) for r in got if r[:2] == ("a", "b")] == list(enumerate(["px", "py", "pz", "qx", "qy", "qz"]))
    assert len(got) == 6 + 9 + 2 and [r[2] for r in got if r[:2] == ("b", "b")] == list(range(9))


def test_only_rhyming_tails_are_aligned(spark, tmp_path, monkeypatch):
    text = "cat\nhat\nday\nknees\nsky\nspaghetti\nconfetti"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, seen = kernel.score_tails, []
    monkeypatch.setattr(kernel, "score_tails", lambda pairs, *a, **k: seen.append(plain(pairs, *a, **k)) or seen[-1])
    rows = catalogue.QUERIES["column_distances"](spark, str(tmp_path)).collect()
    assert rows and seen and all(r.score >= kernel.THRESHOLD for r in seen[0].collect())
