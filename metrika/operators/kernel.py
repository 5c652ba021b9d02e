"""The rhyme kernel: alignment and graded scores of rhyme tails, as expressions.

Tails are first coded: nuclei and coda consonants as integers, schwa columns marked. The
alignment's dynamic programming needs no way back: each cell carries the score sum, the
number of columns, of gaps and of informative columns along its one best path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T

NUCLEUS_WEIGHT, CODA_WEIGHT, GAP, THRESHOLD = 1.0, 0.35, 0.6, 0.75
TIE = 1e-12


def coded(tail: Column) -> Column:
    """array<struct<v, c, w>>: nucleus code, coda codes, whether it is a schwa without coda."""
    names = F.array(*map(F.lit, T.CONSONANTS))
    return F.transform(
        tail,
        lambda s: F.struct(
            P.vowel_code(s["nucleus"]).alias("v"),
            F.transform(s["coda"], lambda c: F.array_position(names, c).cast("int") - 1).alias("c"),
            (P.is_schwa(s) & (F.size(s["coda"]) == 0)).alias("w"),
        ),
    )


def coda_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of codes: mean by place over the longer, a missing one counting 0; two empty ones are equal."""
    flat = F.array(*[F.lit(1.0 - d) for d in T.CONSONANT_DISTANCES])
    n = F.greatest(F.size(a), F.size(b))
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.get(flat, F.get(a, i) * len(T.CONSONANTS) + F.get(b, i)), F.lit(0.0)),
    )
    return F.when(n == 0, 1.0).otherwise(total / n)


def syllable_similarity(a: Column, b: Column, nucleus_weight: float = NUCLEUS_WEIGHT, coda_weight: float = CODA_WEIGHT) -> Column:
    """Of two coded syllables; onsets don't count."""
    flat = F.array(*[F.lit(1.0 - d) for d in T.VOWEL_DISTANCES])
    vowel = F.get(flat, a["v"] * len(T.VOWELS) + b["v"])
    return (F.lit(nucleus_weight) * vowel + F.lit(coda_weight) * coda_similarity(a["c"], b["c"])) / (nucleus_weight + coda_weight)


def align(a: Column, b: Column, nucleus_weight: float = NUCLEUS_WEIGHT, coda_weight: float = CODA_WEIGHT, gap: float = GAP, path: bool = True) -> Column:
    """struct<cost, total, columns, gaps, informative, path> of the best alignment of two coded tails.

    Ties (within TIE) go to the diagonal, then to skipping in a, then to skipping in b. path:
    a letter a column, d, a (only a has a syllable) or b; empty if not asked for.
    """
    distances = F.array(*map(F.lit, T.VOWEL_DISTANCES))

    def cell(cost, total, columns, gaps, informative, taken):
        return F.struct(cost.alias("cost"), total.alias("total"), columns.alias("columns"), gaps.alias("gaps"), informative.alias("informative"), (taken if path else F.lit("")).alias("path"))

    def skip(c, letter):
        return cell(c["cost"] + F.lit(gap), c["total"], c["columns"] + 1, c["gaps"] + 1, c["informative"], F.concat(c["path"], F.lit(letter)))

    def edge(k, letter):
        return cell(k * F.lit(gap), F.lit(0.0), k, k, F.lit(0), F.repeat(F.lit(letter), k))

    def row(before, x, i):
        """The next row of cells, from the row before."""
        return F.aggregate(
            F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j"))),
            F.array(edge(i + 1, "a")),
            lambda acc, e: F.concat(acc, F.array(best(F.get(before, e["j"]), F.get(before, e["j"] + 1), F.element_at(acc, -1), x, e["y"]))),
        )

    def best(corner, up, left, x, y):
        cost = corner["cost"] + F.get(distances, x["v"] * len(T.VOWELS) + y["v"])
        both = cell(cost, corner["total"] + syllable_similarity(x, y, nucleus_weight, coda_weight), corner["columns"] + 1, corner["gaps"], corner["informative"] + F.when(x["w"] & y["w"], 0).otherwise(1), F.concat(corner["path"], F.lit("d")))
        up_cost, left_cost = up["cost"] + F.lit(gap), left["cost"] + F.lit(gap)
        takes_up = up_cost < cost - TIE
        takes_left = left_cost < F.when(takes_up, up_cost).otherwise(cost) - TIE
        return F.when(takes_left, skip(left, "b")).when(takes_up, skip(up, "a")).otherwise(both)

    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: edge(j, "b"))
    rows = F.aggregate(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), first, lambda acc, e: row(acc, e["x"], e["i"]))
    return F.element_at(rows, -1)


def score_of(alignment: Column) -> Column:
    """Mean of the columns' scores; no column scores 0."""
    return F.when(alignment["columns"] > 0, alignment["total"] / alignment["columns"]).otherwise(0.0)


def rhyme_score(a: Column, b: Column, **weights) -> Column:
    """Of two arrays of syllables (pronunciations, not tails); 0 if one has none."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(score_of(align(coded(P.rhyme_tail(a)), coded(P.rhyme_tail(b)), **weights)))


def score_tails(pairs: DataFrame, a: str, b: str, **weights) -> DataFrame:
    """pairs (distinct coded tails a, b) with their alignment and score: rounded to 9 digits, on which all comparison rests."""
    out = pairs.withColumn("alignment", align(F.col(a), F.col(b), **weights))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return out.withColumn("score", F.when(empty, 0.0).otherwise(F.round(score_of(F.col("alignment")), 9)))


def best_scores(pairs: DataFrame, words: DataFrame, **weights) -> DataFrame:
    """pairs (w1, w2) with the best score over the words' variants; words: (word, variants array<array<syllable>>)."""
    side = lambda k: words.select(F.col("word").alias(f"w{k}"), F.transform("variants", lambda v: coded(P.rhyme_tail(v))).alias(f"v{k}"))
    every = pairs.select("w1", "w2").distinct().join(side(1), "w1", "left").join(side(2), "w2", "left")
    rows = every.withColumn("t1", F.explode_outer("v1")).withColumn("t2", F.explode_outer("v2")).select("w1", "w2", "t1", "t2")
    known = rows.where("t1 is not null and t2 is not null")
    # variants repeat tails: each distinct pair of tails is aligned once
    tails = score_tails(known.select("t1", "t2").distinct(), "t1", "t2", **weights).select("t1", "t2", "score", "alignment")
    scored = rows.join(tails, ["t1", "t2"], "left")
    return scored.groupBy("w1", "w2").agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("score"))
