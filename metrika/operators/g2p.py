"""Pronunciations of words: dictionary, slang, spelling rules, letters to sounds.

All work is on distinct lower-cased words; look-ups are joins with the lexicon table, rules
are expressions. The first link that gives a pronunciation wins and names the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import tokenize
from metrika.operators.components import settled

GUESS_COST = 0.1
#: A lexicon of more rows than this is joined by shuffle.
BROADCAST_ROWS = 500_000

# Letter groups and their sounds; the first that fits wins, so the order counts.
GROUPS = {
    "aow": ["AW"], "igh": ["AY"], "tch": ["CH"], "ch": ["CH"], "sh": ["SH"], "th": ["TH"], "ph": ["F"], "wh": ["W"], "ck": ["K"], "ng": ["NG"],
    "qu": ["K", "W"], "ee": ["IY"], "ea": ["IY"], "oo": ["UW"], "ou": ["AW"], "ow": ["AW"], "oa": ["OW"], "ai": ["EY"], "ay": ["EY"], "oi": ["OY"],
    "oy": ["OY"], "au": ["AO"], "aw": ["AO"], "ar": ["AA", "R"], "or": ["AO", "R"], "er": ["ER"], "ir": ["ER"], "ur": ["ER"],
}
# Single letters; c, y and a final i depend on their place.
LETTERS = {
    "a": ["AE"], "b": ["B"], "d": ["D"], "e": ["EH"], "f": ["F"], "g": ["G"], "h": ["HH"], "i": ["IH"], "j": ["JH"], "k": ["K"], "l": ["L"],
    "m": ["M"], "n": ["N"], "o": ["AA"], "p": ["P"], "r": ["R"], "s": ["S"], "t": ["T"], "u": ["AH"], "v": ["V"], "w": ["W"], "x": ["K", "S"],
    "z": ["Z"],
}
SOUNDS = GROUPS | LETTERS
PATTERN = "|".join(GROUPS)


def cleaned(word: Column) -> Column:
    """The spelling that letters are read from: no apostrophes, runs shortened, silent endings gone."""
    s = F.replace(F.lower(word), F.lit("'"), F.lit(""))
    s = F.regexp_replace(s, r"(.)\1{2,}", "$1")
    s = F.regexp_replace(s, r"([^aeiou])\1", "$1")
    # of three letters or more: "ie" loses its e, and so does an e after a consonant
    return F.regexp_replace(s, r"^(.+[^aeouy])e$", "$1")


def only_letters(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("'"), F.lit("")).rlike(r"^\p{L}+$")


def can_be_guessed(word: Column) -> Column:
    """Whether letter_to_sound() gives phones: a vowel is any of a, e, i, o, u but that of qu, and y but in the first place."""
    return only_letters(word) & F.replace(cleaned(word), F.lit("qu"), F.lit("q")).rlike("[aeiou]|.y")


def letter_to_sound(word: Column) -> Column:
    """Phones guessed from a spelling; null without a vowel or with anything but letters and apostrophes.

    The ends are marked ^ and $, and a soft c is C, so that each part has its sounds by itself; only
    the look-up of parts is a lambda, the rest is made on strings.
    """
    by_place = {"c": ["K"], "C": ["S"], "^y": ["Y"], "y$": ["IY"], "y": ["IH"], "i$": ["IY"]}
    sounds = LETTERS | by_place | GROUPS
    spelt = lambda v: " ".join(p + "0" * (p in T.VOWELS) for p in v)
    table = F.create_map(*[F.lit(x) for k, v in sounds.items() for x in (k, spelt(v))])
    marked = F.concat(F.lit("^"), F.regexp_replace(cleaned(word), "c(?=[eiy])", "C"), F.lit("$"))
    parts = F.regexp_extract_all(marked, F.lit(rf"({PATTERN}|\^y|[iy]\$|[^^$])"), 1)
    phones = F.array_join(F.transform(parts, lambda t: F.element_at(table, t)), " ")
    # the first vowel is stressed
    return F.when(only_letters(word), P.let(phones, lambda p: F.when(p.contains("0"), F.split(F.regexp_replace(p, "^([^0]*)0", "$11"), " "))))


def by_word(lexicon: DataFrame) -> DataFrame:
    """(word, variants): phones of all variants, in the dictionary's order."""
    return lexicon.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("variant_idx", "phones"))).alias("all")).select("word", F.transform("all", lambda x: x["phones"]).alias("variants"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def look_up(words: DataFrame, lexicon: DataFrame, key: Column, name: str) -> DataFrame:
    """words with the variants (null: none) of key as column `name`."""
    side = lexicon.select(F.col("word").alias(f"__{name}"), F.col("variants").alias(name))
    return words.join(side, key == F.col(f"__{name}"), "left").drop(f"__{name}")


def known(words: DataFrame, lexicon: DataFrame, slang: DataFrame, *keep: str) -> DataFrame:
    """What the dictionaries give for lower-cased words: word, dictionary, slang, g_drop, stem, a_for_er (variants of phones), and the columns to keep."""
    lex = small(by_word(lexicon))
    w = F.col("word")
    drops = w.rlike(r"^[a-z]+in'?$")
    bare = F.regexp_replace(w, r"'+$", "")
    stem = F.substring(bare, F.lit(1), F.length(bare) - 2)
    doubled = (F.length(stem) >= 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
    out = look_up(words, lex, w, "dictionary")
    out = look_up(out, small(by_word(slang)), w, "slang")
    out = look_up(out, lex, F.when(drops, F.concat(bare, F.lit("g"))), "ing")
    out = look_up(out, lex, F.when(drops, stem), "stem0")
    out = look_up(out, lex, F.when(drops, F.concat(stem, F.lit("e"))), "stem1")
    out = look_up(out, lex, F.when(drops & doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)), "stem2")
    er_key = F.when((F.length(w) >= 3) & w.endswith("a"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("er")))
    out = look_up(out, lex, er_key, "er")
    last = lambda v: F.element_at(v, -1)
    front = lambda v: F.slice(v, 1, F.size(v) - 1)
    g_drop = F.transform("ing", lambda v: F.when(last(v) == "NG", F.concat(front(v), F.array(F.lit("N")))).otherwise(v))
    stems = F.transform(F.coalesce("stem0", "stem1", "stem2"), lambda v: F.concat(v, F.array(F.lit("IH0"), F.lit("N"))))
    ers = F.transform(F.filter("er", lambda v: last(v).startswith("ER")), lambda v: F.concat(front(v), F.array(F.concat(F.lit("AH"), F.substring(last(v), F.lit(3), F.length(last(v)))))))
    return out.select(
        *keep, "word", "dictionary", "slang", g_drop.alias("g_drop"), F.when(F.col("ing").isNull(), stems).alias("stem"),
        F.when(F.size(ers) > 0, ers).alias("a_for_er"),
    )


def chain(words: DataFrame, lexicon: DataFrame, slang: DataFrame, *keep: str) -> DataFrame:
    """Every link's result: known() and letters, variants of phones.

    Joins with the dictionaries only, so words may be a stream.
    """
    guessed = P.let(letter_to_sound(F.col("word")), lambda g: F.when(g.isNotNull(), F.array(g)))
    return known(words, lexicon, slang, *keep).withColumn("letters", guessed)


SOURCES = [("dictionary", "dictionary"), ("slang", "lexicon"), ("g_drop", "g-drop"), ("stem", "stem+-in'"), ("a_for_er", "-a-for-er"), ("letters", "letter-to-sound")]


def fits(name: str) -> Column:
    """Whether a link has a result; that of a rule must have a vowel."""
    has = F.col(name).isNotNull()
    return has & F.exists(name, lambda v: F.exists(v, P.is_vowel)) if name in ("g_drop", "stem", "a_for_er") else has


def spread(rows: DataFrame) -> DataFrame:
    """rows that are few bytes but much work, in a fixed number of partitions, which adaptive execution doesn't take together.

    They are dealt in turn: rows already dealt by a key would not be dealt by it again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pronounce(words: DataFrame, lexicon: DataFrame, slang: DataFrame) -> DataFrame:
    """word (distinct, lower-case), source, cost, prons (array of arrays of syllables; none: the word can't be voiced).

    A dictionary or slang word keeps its source even if no variant has a vowel; a rule whose
    variants have none gives way to the next.
    """
    distinct = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    return voiced(chain(spread(distinct), lexicon, slang))


def voiced(made: DataFrame, *keep: str) -> DataFrame:
    """chain()'s rows with the first link that gives a pronunciation: word, source, cost, prons, and the columns to keep."""
    links = []
    for name, label in SOURCES:
        link = F.struct(F.lit(label).alias("source"), F.col(name).alias("variants"))
        links.append(F.when(fits(name), link))
    out = made.select(*keep, "word", F.coalesce(*links).alias("found"))
    out = out.select(*keep, "word", F.coalesce("found.source", F.lit("oov")).alias("source"), F.col("found.variants").alias("variants"))
    prons = F.filter(F.transform("variants", P.syllabify), lambda s: F.size(s) > 0)
    cost = F.when(F.col("source") == "letter-to-sound", GUESS_COST).otherwise(0.0)
    return out.select(*keep, "word", "source", cost.alias("cost"), F.coalesce(prons, F.array().cast(f"array<array<{P.SYLLABLE}>>")).alias("prons"))


def word_provenance(tokens: DataFrame, pron: DataFrame) -> DataFrame:
    """verse_id, word (its first form), source, line, word_idx of each verse's words, by lower case, that the dictionary doesn't have."""
    place = F.struct("line", "word_idx", "word")
    first = tokens.groupBy("verse_id", F.lower("word").alias("key")).agg(F.min(place).alias("at"))
    own = first.join(pron.select(F.col("word").alias("key"), "source"), "key").where("source <> 'dictionary'")
    return own.select("verse_id", F.col("at.word").alias("word"), "source", F.col("at.line").alias("line"), F.col("at.word_idx").alias("word_idx"))


def first_words(verses: DataFrame) -> DataFrame:
    """verse_id, key, line, word_idx, word: the first place of each lower-cased word of a row's text, found inside the row."""
    places = F.transform(tokenize.lines_of(F.col("text")), lambda raw, line: F.transform(tokenize.words_of(raw), lambda w, i: F.struct(F.lower(w).alias("key"), line.alias("line"), i.alias("word_idx"), w.alias("word"))))
    firsts = P.let(F.array_sort(F.flatten(places)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    return verses.select("verse_id", F.explode(firsts).alias("x")).select("verse_id", "x.*")


def provenance(verses: DataFrame, lexicon: DataFrame, slang: DataFrame) -> DataFrame:
    """As word_provenance(), of verses (verse_id, text), without dealing out words.

    A row's words are told apart inside the row; rows of a verse_id that comes again are brought
    together. Sources are found for distinct words, and only those of words that are not read
    from their letters are joined, by broadcast where they are few.
    """
    again = verses.groupBy("verse_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("verse_id").alias("__v"))
    same = F.col("verse_id").eqNullSafe(F.col("__v"))
    place = F.struct("line", "word_idx", "word")
    merged = first_words(verses.join(again, same, "left_semi")).groupBy("verse_id", "key").agg(F.min(place).alias("at")).select("verse_id", "key", "at.*")
    firsts = first_words(verses.join(again, same, "left_anti")).unionByName(merged)
    words = verses.select(F.explode(tokenize.words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("word")).distinct()
    has = {name: fits(name) if name != "letters" else can_be_guessed(F.col("word")) for name, _ in SOURCES}
    source = F.coalesce(*[F.when(has[name], F.lit(label)) for name, label in SOURCES], F.lit("oov"))
    others = settled(known(spread(words), lexicon, slang).select(F.col("word").alias("key"), source.alias("source")).where(F.col("source") != SOURCES[-1][1]))
    found = firsts.join(small(others), "key", "left").withColumn("source", F.coalesce("source", F.lit(SOURCES[-1][1])))
    return found.where("source <> 'dictionary'").select("verse_id", "word", "source", "line", "word_idx")


def pronunciations_for(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, variant_idx, pronunciation of every dictionary variant (also without a vowel); words that it lacks give no row."""
    own = words.select("word").distinct()
    out = own.join(lexicon.withColumnRenamed("word", "__w"), F.lower("word") == F.col("__w"))
    return out.select("word", "variant_idx", F.struct(P.syllabify(F.col("phones")).alias("syllables"), F.col("word").alias("text")).alias("pronunciation"))


def pronunciation_for(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The first variant of every word, or null."""
    first = pronunciations_for(words, lexicon).where("variant_idx = 0").drop("variant_idx")
    return words.select("word").distinct().join(first, "word", "left")


def pronunciations_for_span(spans: DataFrame, lexicon: DataFrame, only_first: bool = False) -> DataFrame:
    """span_id, variant_idx, pronunciation: all combinations of the words' variants, the last word's changing fastest; a span with an unknown word gives none.

    spans: span_id, words (array).
    """
    each = spans.select("span_id", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    known = pronunciations_for(each, lexicon)
    known = known.where("variant_idx = 0") if only_first else known
    lists = known.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("variant_idx", "pronunciation"))).alias("v")).select("word", F.transform("v", lambda x: x["pronunciation"]).alias("v"))
    return combinations(each, lists)


def combinations(each: DataFrame, lists: DataFrame) -> DataFrame:
    """span_id, variant_idx, pronunciation of spans' words (span_id, n, i, word) and words' variants (word, v: array of pronunciations).

    How many combinations a span has is known before any is made; each row makes its own from
    its number, the last word's variants being the last digit. A frequent word's variants go by
    broadcast where they are few in all, else its rows are split by Spark's join of skewed parts.
    """
    whole = each.join(small(lists), "word").groupBy("span_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")).where(F.size("all") == F.col("n"))
    sizes = F.transform("all", lambda w: F.size(w["v"]).cast("long"))
    times = lambda values: F.aggregate(values, F.lit(1).cast("long"), lambda acc, n: acc * n)
    numbered = whole.withColumn("sizes", sizes).select("span_id", "all", "sizes", F.explode(F.sequence(F.lit(0).cast("long"), times(F.col("sizes")) - 1)).alias("variant_idx"))
    after = lambda i: times(F.slice("sizes", i + 2, F.size("sizes")))
    digit = lambda w, i: F.floor(F.col("variant_idx") / after(i)) % F.size(w["v"])
    combo = F.transform("all", lambda w, i: F.get(w["v"], digit(w, i).cast("int")))
    return numbered.select("span_id", F.col("variant_idx").cast("int").alias("variant_idx"), P.concat_pronunciations(combo).alias("pronunciation"))


def pair_readings(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """w1, w2, variant_idx, v1, v2: combinations() of two words, numbered as there; lists: word, v (array of any kind).

    A pair is joined with each of its words and never gathered.
    """
    side = lambda k: small(lists).select(F.col("word").alias(f"w{k}"), F.col("v").alias(f"all{k}"))
    both = pairs.select("w1", "w2").join(side(1), "w1").join(side(2), "w2").select("w1", "w2", F.posexplode("all1").alias("i", "v1"), "all2")
    each = both.select("w1", "w2", "i", "v1", F.size("all2").alias("n"), F.posexplode("all2").alias("j", "v2"))
    return each.select("w1", "w2", (F.col("i") * F.col("n") + F.col("j")).alias("variant_idx"), "v1", "v2")
