"""Column functions over phones and syllables; all are built-in expressions.

A syllable is struct<onset, nucleus, coda, stress>; stress is 0 (none), 1 (primary) or 2
(secondary). A pronunciation is struct<syllables, text>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

SYLLABLE = "struct<onset:array<string>,nucleus:string,coda:array<string>,stress:int>"
PRONUNCIATION = f"struct<syllables:array<{SYLLABLE}>,text:string>"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def no_syllables() -> Column:
    return F.array().cast(f"array<{SYLLABLE}>")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside lambdas every mention of an expression is computed anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_phoneme(p: Column) -> Column:
    return F.translate(p, "0123456789", "")


def stress_digit(p: Column) -> Column:
    """The trailing digit, or null."""
    return F.right(p, F.lit(1)).try_cast("int")


def is_vowel(p: Column) -> Column:
    return base_phoneme(p).isin(T.VOWELS)


def is_legal_onset(cluster: Column) -> Column:
    joined, n = F.array_join(cluster, " "), F.size(cluster)
    return F.when(n == 0, True).when(n == 1, ~joined.isin(T.ILLEGAL_ONSETS)).when(n == 2, joined.isin(T.ONSETS_2)).when(n == 3, joined.isin(T.ONSETS_3)).otherwise(False)


def onset_length(cluster: Column) -> Column:
    """Length of the longest legal onset that a run of consonants ends with."""
    n = F.size(cluster)
    tail = lambda k: F.array_join(F.slice(cluster, F.greatest(n - (k - 1), F.lit(1)), k), " ")
    return F.when((n >= 3) & tail(3).isin(T.ONSETS_3), 3).when((n >= 2) & tail(2).isin(T.ONSETS_2), 2).when((n >= 1) & ~tail(1).isin(T.ILLEGAL_ONSETS), 1).otherwise(0)


def split_consonants(cluster: Column) -> Column:
    """struct<coda, onset>: as much as is legal goes to the following syllable."""
    k = onset_length(cluster)
    n = F.size(cluster)
    return F.struct(F.slice(cluster, 1, n - k).alias("coda"), F.slice(cluster, n - k + 1, k).alias("onset"))


def syllabify(phones: Column) -> Column:
    """Syllables of an array of phones: one a vowel; none without a vowel."""

    def whole(ph, at):
        """ph: phones; at: places of the vowels."""
        # consonants before each vowel that are its onset: all before the first, else as many as are legal
        gap = lambda k: F.slice(ph, F.get(at, k - 1) + 2, F.get(at, k) - F.get(at, k - 1) - 1)
        onsets = F.transform(at, lambda v, k: F.when(k == 0, v).otherwise(let(gap(F.greatest(k, F.lit(1))), onset_length)))
        return let(onsets, lambda own: F.transform(at, lambda v, k: one(ph, at, own, v, k)))

    def one(ph, at, own, v, k):
        end = F.when(k == F.size(at) - 1, F.size(ph)).otherwise(F.get(at, k + 1) - F.get(own, k + 1))
        p = F.get(ph, v)
        return F.struct(
            F.slice(ph, v - F.get(own, k) + 1, F.get(own, k)).alias("onset"),
            base_phoneme(p).alias("nucleus"),
            F.slice(ph, v + 2, end - v - 1).alias("coda"),
            F.coalesce(stress_digit(p), F.lit(0)).alias("stress"),
        )

    places = lambda ph: F.filter(F.transform(ph, lambda p, i: F.when(is_vowel(p), i)), lambda i: i.isNotNull())
    found = let(phones, lambda ph: let(places(ph), lambda at: F.when(F.size(at) == 0, no_syllables()).otherwise(whole(ph, at))))
    return F.when(phones.isNotNull(), found)


def rime(syllable: Column) -> Column:
    return F.concat(F.array(syllable["nucleus"]), syllable["coda"])


def syllable_text(s: Column) -> Column:
    return F.array_join(F.concat(s["onset"], F.array(F.concat(s["nucleus"], s["stress"].cast("string"))), s["coda"]), " ")


def syllables_text(syllables: Column) -> Column:
    return F.array_join(F.transform(syllables, syllable_text), " . ")


def pronunciation_text(p: Column) -> Column:
    return F.concat(F.when(F.coalesce(p["text"], F.lit("")) != "", F.concat(p["text"], F.lit(": "))).otherwise(""), syllables_text(p["syllables"]))


def vowel_skeleton(syllables: Column) -> Column:
    return F.transform(syllables, lambda s: s["nucleus"])


def stresses(syllables: Column) -> Column:
    return F.transform(syllables, lambda s: s["stress"])


def concat_pronunciations(prons: Column) -> Column:
    """One pronunciation of an array of them; empty texts are left out, and no text at all is null."""
    texts = F.filter(F.transform(prons, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    joined = F.when(F.size(texts) > 0, F.array_join(texts, " "))
    return F.struct(F.flatten(F.transform(prons, lambda p: p["syllables"])).alias("syllables"), joined.alias("text"))


def tail_start(syllables: Column) -> Column:
    """1-based start of the rhyme tail: the last primary stress, else the last secondary, else the last syllable."""
    last = lambda k: F.array_max(F.transform(syllables, lambda s, i: F.when(s["stress"] == k, i + 1)))
    return F.coalesce(last(1), last(2), F.size(syllables))


def rhyme_tail(syllables: Column) -> Column:
    return F.when(F.size(syllables) == 0, no_syllables()).otherwise(F.slice(syllables, F.greatest(tail_start(syllables), F.lit(1)), F.greatest(F.size(syllables), F.lit(1))))


def is_schwa(s: Column) -> Column:
    return (s["nucleus"] == "AH") & (s["stress"] == 0)


def can_anchor(s: Column) -> Column:
    return ~is_schwa(s)


def coerce_stress(syllables: Column, anchor: Column) -> Column:
    """The anchor gets primary stress, all that follows none, what is before stays."""
    return F.transform(syllables, lambda s, i: s.withField("stress", F.when(i == anchor, 1).when(i > anchor, 0).otherwise(s["stress"])))


def parse_arpabet(text: Column) -> Column:
    """Syllables of 'K AE1 T . S IY0'; null if a symbol is unknown or a syllable hasn't exactly one vowel."""
    parts = F.transform(F.split(F.trim(text), r"\s*\.\s*"), lambda s: F.split(F.trim(s), r"\s+"))

    def one(p):
        k = F.array_position(F.transform(p, lambda x: is_vowel(x)), True).cast("int")
        v = F.get(p, k - 1)
        return F.struct(F.slice(p, 1, F.greatest(k - 1, F.lit(0))).alias("onset"), base_phoneme(v).alias("nucleus"), F.slice(p, k + 1, F.size(p)).alias("coda"), F.coalesce(stress_digit(v), F.lit(0)).alias("stress"))

    known = F.forall(parts, lambda p: F.forall(p, lambda x: is_vowel(x) | x.isin(T.CONSONANTS)) & (F.size(F.filter(p, is_vowel)) == 1))
    return F.when(known, F.transform(parts, one))


def vowel_code(nucleus: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, T.VOWELS)), nucleus).cast("int") - 1


def vowel_distance(a: Column, b: Column) -> Column:
    """By look-up; stress digits are ignored."""
    flat = F.array(*map(F.lit, T.VOWEL_DISTANCES))
    return F.get(flat, vowel_code(base_phoneme(a)) * len(T.VOWELS) + vowel_code(base_phoneme(b)))


def consonant_distance(a: Column, b: Column) -> Column:
    names, flat = F.array(*map(F.lit, T.CONSONANTS)), F.array(*map(F.lit, T.CONSONANT_DISTANCES))
    code = lambda c: F.array_position(names, c).cast("int") - 1
    return F.get(flat, code(a) * len(T.CONSONANTS) + code(b))


def vowel_similarity(a: Column, b: Column) -> Column:
    return 1.0 - vowel_distance(a, b)


def consonant_similarity(a: Column, b: Column) -> Column:
    return 1.0 - consonant_distance(a, b)
