"""The scanner: candidates, the proximity join, gated scores, selection, classes and compounds.

Every table is keyed by verse_id. A candidate is (verse_id, line, start, n_words, anchor);
"before" is that order. Greedy selection, classes and chains are made in checkpointed rounds
over all verses at once, when their tables are first asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import components, g2p, kernel, rhymes, tokenize

MAX_SPAN_WORDS, MAX_LINE_GAP, SEED, COERCION = 4, 2, 0.8, 0.15
# Weak words by default, and those of them that can't carry a rhyme at all.
FUNCTION_WORDS = [
    "a", "an", "the", "and", "but", "or", "nor", "so", "if", "as", "than", "then", "of", "to", "in", "on", "at", "by", "for", "with", "from", "up",
    "down", "out", "off", "over", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our",
    "their", "this", "that", "these", "those", "is", "am", "are", "was", "were", "be", "been", "do", "does", "did", "have", "has", "had", "will",
    "would", "can", "could", "shall", "should", "may", "might", "must", "not", "no",
]
NEVER_ANCHOR = [
    "a", "an", "the", "and", "but", "or", "nor",
]
KEY = ["verse_id", "line", "start", "n_words", "anchor"]
BLOCK = 256


def is_function_word(word: Column) -> Column:
    return F.lower(word).isin(FUNCTION_WORDS)


def span_ngrams(tokens: DataFrame, max_span_words: int = MAX_SPAN_WORDS) -> DataFrame:
    """verse_id, line, start, n_words, span (array of the line's word structs): all windows of 1 to max_span_words words."""
    extra = [c for c in tokens.columns if c not in ("verse_id", "line", "word_idx")]
    line = Window.partitionBy("verse_id", "line").orderBy("word_idx")
    word = F.struct("word_idx", *extra)
    # each word with those after it, so that a long line is never carried whole
    ahead = F.array(*[F.lead(word, k).over(line) if k else word for k in range(max_span_words)])
    starts = tokens.select("verse_id", "line", F.col("word_idx").alias("start"), F.filter(ahead, lambda w: w.isNotNull()).alias("ahead"))
    spans = starts.select("verse_id", "line", "start", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("n_words"))
    return spans.select("verse_id", "line", "start", "n_words", F.slice("ahead", 1, F.col("n_words")).alias("span"))


def anchored_readings(tokens: DataFrame, pron: DataFrame, max_span_words: int = MAX_SPAN_WORDS) -> DataFrame:
    """KEY, words, reading_idx, tail (syllables from the anchor, as performed), cost: a row a reading."""
    voiced = tokens.join(pron.select(F.col("word").alias("__w"), "cost", "prons"), F.lower("word") == F.col("__w")).drop("__w")
    # an unknown word is kept, without variants, so that windows don't close over it
    spans = span_ngrams(voiced.select("verse_id", "line", "word_idx", "word", "cost", "prons"), max_span_words)
    first = F.get("span", F.lit(0))
    spans = spans.where(~F.lower(first["word"]).isin(NEVER_ANCHOR)).where(F.forall("span", lambda w: F.size(w["prons"]) > 0))
    begin = F.transform(first["prons"], lambda v: F.struct(F.size(v).alias("k"), v.alias("s")))
    rest = F.slice("span", 2, F.size("span"))
    product = F.aggregate(rest, begin, lambda acc, w: F.flatten(F.transform(acc, lambda a: F.transform(w["prons"], lambda v: F.struct(a["k"].alias("k"), F.concat(a["s"], v).alias("s"))))))
    guessed = F.aggregate("span", F.lit(0.0), lambda acc, w: acc + w["cost"])
    words = F.array_join(F.transform("span", lambda w: w["word"]), " ")
    rows = spans.select("verse_id", "line", "start", "n_words", words.alias("words"), is_function_word(first["word"]).alias("weak"), guessed.alias("guessed"), F.posexplode(product).alias("reading_idx", "r"))
    anchors = F.filter(F.sequence(F.lit(0), F.col("r.k") - 1), lambda i: P.can_anchor(F.get("r.s", i)))
    rows = rows.withColumn("anchor", F.explode(anchors))
    at = F.get("r.s", F.col("anchor"))
    cost = F.when((at["stress"] == 0) | F.col("weak"), COERCION).otherwise(0.0) + F.col("guessed")
    performed = P.coerce_stress(F.col("r.s"), F.col("anchor"))
    return rows.select(*KEY, "words", "reading_idx", F.slice(performed, F.col("anchor") + 1, F.size("r.s")).alias("tail"), cost.alias("cost"))


def enumerate_candidates(readings: DataFrame) -> DataFrame:
    """KEY, words, n_readings, min_cost: a row a candidate."""
    return readings.groupBy(*KEY, "words").agg(F.count("*").alias("n_readings"), F.round(F.min("cost"), 9).alias("min_cost"))


def same_line_or_after(max_line_gap: int) -> Column:
    """Of a joined row a_*, b_*: b comes after a, near enough, and shares no word with it."""
    return (F.col("b_line") <= F.col("a_line") + max_line_gap) & ((F.col("b_line") > F.col("a_line")) | ((F.col("b_line") == F.col("a_line")) & (F.col("b_start") >= F.col("a_start") + F.col("a_n_words"))))


def sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("verse_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "verse_id"])


def near(a: DataFrame, b: DataFrame, max_line_gap: int = MAX_LINE_GAP, *more: str) -> DataFrame:
    """Pairs of rows of a (a_*) and b (b_*) that are pairable, by equality. more: columns, without side, that must be equal.

    b is repeated for each line from which it is near, and there for each block of BLOCK words in
    which a may start: a key has a block's rows of a, however long the line.
    """
    block = F.floor(F.col("a_start") / BLOCK).cast("int")
    left = sided(a, "a").withColumn("bucket", F.col("a_line")).withColumn("block", block)
    reach = sided(b, "b").withColumn("bucket", F.explode(F.sequence(F.greatest(F.col("b_line") - max_line_gap, F.lit(0)), F.col("b_line"))))
    lines = left.groupBy("verse_id", "bucket").agg(F.max("block").alias("last"))
    own = F.floor(F.col("b_start") / BLOCK).cast("int")
    upto = F.when(F.col("bucket") == F.col("b_line"), F.least("last", own)).otherwise(F.col("last"))
    reach = reach.join(lines, ["verse_id", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), upto))).drop("last")
    for m in more:
        left, reach = left.withColumnRenamed(f"a_{m}", m), reach.withColumnRenamed(f"b_{m}", m)
    return left.join(reach, ["verse_id", "bucket", "block", *more]).where(same_line_or_after(max_line_gap)).drop("bucket", "block")


def compatible(seed: float = SEED) -> list[tuple[str, str]]:
    n = len(T.VOWELS)
    return [(a, b) for i, a in enumerate(T.VOWELS) for j, b in enumerate(T.VOWELS) if 1.0 - T.VOWEL_DISTANCES[i * n + j] >= seed]


def find_matches(readings: DataFrame, threshold: float = kernel.THRESHOLD, seed_threshold: float = SEED, max_line_gap: int = MAX_LINE_GAP) -> DataFrame:
    """a_*, b_* (keys and words), score (9 digits), length, informative_length of the pairs that reach the threshold.

    The seed gate is part of the join's key: a's nucleus meets only those near enough.
    Distinct pairs of tails are aligned once.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less would admit pairs without an open seed")
    spark = readings.sparkSession
    # readings that differ in nothing but citation stress are one: the lowest index stays
    rows = readings.withColumn("seed", F.get("tail", F.lit(0)))
    rows = rows.withColumn("onset", F.array_join("seed.onset", " ")).withColumn("coda", F.array_join("seed.coda", " ")).withColumn("nucleus", F.col("seed.nucleus"))
    rows = rows.withColumn("code", kernel.coded(F.col("tail"))).withColumn("cost", F.round("cost", 9))
    rows = rows.groupBy(*KEY, "words", "onset", "nucleus", "coda", "code", "cost").agg(F.min("reading_idx").alias("reading_idx"))
    rows = components.settled(rows)
    # pairs carry numbers of tails, not tails
    tails = components.settled(rows.select("code").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("code").alias("t")))
    rows = rows.join(tails.select(F.col("id").alias("tail_id"), F.col("t").alias("code")), "code").withColumn("size", F.size("code")).drop("code")
    gate = F.broadcast(spark.createDataFrame(compatible(seed_threshold), "nucleus string, partner string"))  # 225 rows at most
    opened = rows.join(gate, "nucleus").withColumn("own", F.col("nucleus")).drop("nucleus").withColumnRenamed("partner", "nucleus")
    pairs = near(opened, rows.withColumn("own", F.col("nucleus")), max_line_gap, "nucleus")
    same_seed = (F.col("a_own") == F.col("b_own")) & (F.col("a_onset") == F.col("b_onset")) & (F.col("a_coda") == F.col("b_coda"))
    # a column scores at most 1 and there are as many as the longer tail has: the shares of tails that
    # are too different in length, or cost too much, can't reach the threshold and aren't aligned
    most = F.least("a_size", "b_size") / F.greatest("a_size", "b_size")
    pairs = pairs.where(~same_seed).where(most - F.col("a_cost") - F.col("b_cost") >= threshold - 1e-9)
    # a cost only lowers a score, so what is below the threshold without it is out
    asked = pairs.select(F.col("a_tail_id").alias("a"), F.col("b_tail_id").alias("b")).distinct()
    scores = rhymes.reaching(rhymes.with_tails(asked, tails), threshold, counts=True)
    scores = scores.select(F.col("a").alias("a_tail_id"), F.col("b").alias("b_tail_id"), F.col("score").alias("plain"), "columns", "informative")
    scored = pairs.join(scores, ["a_tail_id", "b_tail_id"]).withColumn("score", F.round(F.col("plain") - F.col("a_cost") - F.col("b_cost"), 9))
    scored = scored.where(F.col("score") >= threshold)
    own = ["verse_id", *[f"{s}_{c}" for s in "ab" for c in (*KEY[1:], "words")]]
    best = F.max(F.struct("score", (-F.col("a_reading_idx")).alias("i"), (-F.col("b_reading_idx")).alias("j"), F.col("columns").alias("length"), "informative")).alias("m")
    return scored.groupBy(*own).agg(best).select(*own, F.col("m.score").alias("score"), F.col("m.length").alias("length"), F.col("m.informative").alias("informative_length"))


ORDER = ["a_line", "a_start", "a_n_words", "a_anchor", "b_line", "b_start", "b_n_words", "b_anchor"]


def first_at_all(cells: DataFrame, *place: str) -> DataFrame:
    """verse_id, __p of the items that a greedy choice in the order of __p takes, if no two may share a place.

    cells: verse_id, __p and a place that the item has; a row a place. Each round takes the items
    that are first at all their places and drops those that share a place with one of them.
    """
    by_cell, by_item = Window.partitionBy("verse_id", *place), Window.partitionBy("verse_id", "__p")
    taken = None
    while True:
        state = cells.withColumn("taken", F.min("__p").over(by_cell)).withColumn("taken", F.min("taken").over(by_item) == F.col("__p"))
        state = state.withColumn("gone", F.max("taken").over(by_cell)).withColumn("gone", F.max("gone").over(by_item))
        state = components.settled(state.where("taken or not gone"))
        own = state.where("taken").select("verse_id", "__p").distinct()
        taken = own if taken is None else taken.unionByName(own)
        cells = state.where("not gone").select("verse_id", "__p", *place)
        if cells.isEmpty():
            return taken


def select_matches(matches: DataFrame) -> DataFrame:
    """The matches of which none better describes the same event, with sel_idx, the order in which they were taken.

    Greedy within a verse: best score, most informative, shortest, nearest, first. Two matches
    describe the same event if they share a pair of word places, one on each side. So a match is
    taken if it is the best of all that are left at each of its pairs of places, which goes on
    in rounds for all verses at once; no verse is gathered, and no two matches are compared.
    """
    rank = [F.desc("score"), F.desc("informative_length"), F.asc("length"), F.col("b_line") - F.col("a_line"), "b_start", "a_line", "a_start"]
    placed = components.settled(matches.withColumn("__p", F.row_number().over(Window.partitionBy("verse_id").orderBy(*rank, *ORDER))))
    covered = [F.sequence(F.col(f"{s}_start"), F.col(f"{s}_start") + F.col(f"{s}_n_words") - 1) for s in "ab"]
    cells = placed.select("verse_id", "__p", "a_line", "b_line", F.explode(covered[0]).alias("a_at"), covered[1].alias("bs"))
    cells = cells.select("verse_id", "__p", "a_line", "b_line", "a_at", F.explode("bs").alias("b_at"))
    chosen = placed.join(first_at_all(cells, "a_line", "b_line", "a_at", "b_at"), ["verse_id", "__p"], "left_semi")
    rest = [c for c in matches.columns if c != "verse_id"]
    sel_idx = F.row_number().over(Window.partitionBy("verse_id").orderBy("__p")) - 1
    return chosen.select("verse_id", sel_idx.alias("sel_idx"), *rest)


def scan_groups(selected: DataFrame) -> DataFrame:
    """verse_id, class_idx, member_idx, line, start, n_words, anchor, words: rhyme classes of the matched candidates, in verse order."""
    own = [*KEY[1:], "words"]
    a, b = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in own]) for s in "ab")
    edges = selected.select(F.col("verse_id").alias("scope"), a.alias("a"), b.alias("b"))
    nodes = edges.select("scope", F.explode(F.array("a", "b")).alias("node"))
    found = components.connected_components(nodes, edges)
    class_idx = F.dense_rank().over(Window.partitionBy("scope").orderBy("component")) - 1
    member_idx = F.row_number().over(Window.partitionBy("scope", "component").orderBy("node")) - 1
    return found.select(F.col("scope").alias("verse_id"), class_idx.alias("class_idx"), member_idx.alias("member_idx"), *[F.col(f"node.{c}").alias(c) for c in own])


def abuts(selected: DataFrame) -> DataFrame:
    """verse_id, x, y (sel_idx): y goes on where x ends, on both sides."""
    x = selected.select("verse_id", F.col("sel_idx").alias("x"), F.col("a_line").alias("al"), (F.col("a_start") + F.col("a_n_words")).alias("ap"), F.col("b_line").alias("bl"), (F.col("b_start") + F.col("b_n_words")).alias("bp"))
    y = selected.select("verse_id", F.col("sel_idx").alias("y"), F.col("a_line").alias("al"), F.col("a_start").alias("ap"), F.col("b_line").alias("bl"), F.col("b_start").alias("bp"))
    return x.join(y, ["verse_id", "al", "ap", "bl", "bp"]).select("verse_id", "x", "y")


def chain_matches(selected: DataFrame) -> DataFrame:
    """selected with compound_idx and beat_idx: components of matches that abut, beats by a's place; every match is in one."""
    place = F.row_number().over(Window.partitionBy("verse_id").orderBy("a_line", "a_start", "sel_idx"))
    placed = components.settled(selected.withColumn("__p", place))
    edges = abuts(placed.select(*[F.col("__p").alias("sel_idx") if c == "sel_idx" else F.col(c) for c in selected.columns]))
    nodes = placed.select(F.col("verse_id").alias("scope"), F.col("__p").alias("node"))
    found = components.connected_components(nodes, edges.select(F.col("verse_id").alias("scope"), F.col("x").alias("a"), F.col("y").alias("b")))
    joined = placed.join(found.select(F.col("scope").alias("verse_id"), F.col("node").alias("__p"), "component"), ["verse_id", "__p"])
    compound_idx = F.dense_rank().over(Window.partitionBy("verse_id").orderBy("component")) - 1
    beat_idx = F.row_number().over(Window.partitionBy("verse_id", "component").orderBy("__p")) - 1
    return joined.select(*selected.columns, compound_idx.alias("compound_idx"), beat_idx.alias("beat_idx"))


def compound_text(chained: DataFrame) -> DataFrame:
    """verse_id, compound_idx, beats, text: '[left words] ~ [right words] (n beats)'."""
    beats = F.array_sort(F.collect_list(F.struct("beat_idx", "a_words", "b_words")))
    out = chained.groupBy("verse_id", "compound_idx").agg(beats.alias("all"))
    side = lambda s: F.array_join(F.transform("all", lambda x: x[s]), " ")
    return out.select("verse_id", "compound_idx", F.size("all").alias("beats"), F.format_string("[%s] ~ [%s] (%d beat%s)", side("a_words"), side("b_words"), F.size("all"), F.when(F.size("all") == 1, "").otherwise("s")).alias("text"))


class VerseScan:
    """What a scan of a table of verses (verse_id, text) finds; tables are made when asked for.

    What several tables are made from is written to the checkpoint folder once it is made; nothing
    is kept on executors, and no scan uses another's.
    """

    def __init__(self, verses: DataFrame, lexicon: DataFrame, slang: DataFrame, max_span_words: int = MAX_SPAN_WORDS, threshold: float = kernel.THRESHOLD, seed_threshold: float = SEED, max_line_gap: int = MAX_LINE_GAP):
        self.verses, self.dictionaries = verses, (lexicon, slang)
        self.max_span_words, self.match_knobs = max_span_words, (threshold, seed_threshold, max_line_gap)
        self.tokens = tokenize.tokenize_verse(verses)

    @functools.cached_property
    def pron(self) -> DataFrame:
        return components.settled(g2p.pronounce(self.tokens.select("word"), *self.dictionaries))

    @property
    def readings(self) -> DataFrame:
        return anchored_readings(self.tokens, self.pron, self.max_span_words)

    @functools.cached_property
    def matches(self) -> DataFrame:
        return components.settled(find_matches(self.readings, *self.match_knobs))

    @functools.cached_property
    def selected(self) -> DataFrame:
        return components.settled(select_matches(self.matches))

    @property
    def candidates(self) -> DataFrame:
        return enumerate_candidates(self.readings)

    @functools.cached_property
    def groups(self) -> DataFrame:
        return scan_groups(self.selected)

    @functools.cached_property
    def compounds(self) -> DataFrame:
        return chain_matches(self.selected)

    @property
    def provenance(self) -> DataFrame:
        return g2p.word_provenance(self.tokens, self.pron)


def scan_verse(verses: DataFrame, lexicon: DataFrame, slang: DataFrame, **knobs) -> VerseScan:
    """verses: verse_id, text. Scan all verses at once."""
    return VerseScan(verses, lexicon, slang, **knobs)
