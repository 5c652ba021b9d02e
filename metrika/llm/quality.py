"""Quality rules with risk-controlled cutoffs.

Base counts are made for every whole text; from them come rule scores (higher is worse).
For each stratum (language) the labelled documents that pass the base are split by crc32 of
doc_id: good ones of one part in TUNE, and all bad ones, propose a sequence of verdicts; the
other good ones test it. Each verdict of the sequence is a union of rules at cutoffs and rejects
what the one before rejects and more, beginning with the cutoffs that met fewest good documents.
The share of good documents that a whole verdict rejects has the exact (Clopper-Pearson) upper
bound at confidence 1 - delta / strata; the verdicts are tested in order and the last before the
first whose bound is over `risk` is taken. As the sequence doesn't depend on the documents that
test it, all its tests together need no further correction (fixed-sequence testing), and
Bonferroni holds over the strata. A stratum whose first verdict fails has no rule beyond the base:
with 2 %, 95 % and four strata at least 219 testing documents must be there.

Defined cases: null text counts as no words (base fails); a null or unseen stratum has no
rules; documents without a label never calibrate; several labels of a doc_id count as one
(the lowest); texts of any length are counted whole; of steps that met equally many good
documents that with more bad ones comes first, then the rule first by name; an empty table
gives no rows. Calibration covers all labelled rows and is gathered as counts on a fixed grid,
so what reaches the driver doesn't grow with the data.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, dropped, map_texts, stored, table

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule scores and the cutoffs that are tried; a document is rejected if its score is over the cutoff.
RULES = {
    "symbols_per_word": np.linspace(0.05, 2.0, 40),
    "duplicate_line_share": np.linspace(0.025, 1.0, 40),
    "repeated_word_share": np.linspace(0.01, 0.4, 40),
    "upper_share": np.linspace(0.025, 1.0, 40),
    "exclaim_per_word": np.linspace(0.05, 2.0, 40),
    "digit_share": np.linspace(0.025, 1.0, 40),
    "same_next_word_share": np.linspace(0.025, 1.0, 40),
    "long_word_mean": np.linspace(6.0, 25.5, 40),
}
#: Labelled documents with crc32(doc_id) divisible by TUNE propose verdicts, the others test them.
TUNE = 4
PRIVATE = "__quality_"  # begins the names of working columns, so that columns of the table can't clash


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows of `window` words that are found twice or more; exact for a power of two."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, width = ids, 1
    while width < window:
        pairs = rank[:-width].astype(np.int64) * (len(ids) + 1) + rank[width:]
        _, rank = np.unique(pairs, return_inverse=True)
        width *= 2
        if width < window and int(rank.max()) + 1 == len(rank):
            return 0
    rank = rank[:n]
    often = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(often):
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple:
    """(base counts..., rule scores...) of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0, *[0.0] * len(RULES))
    if len(raw) == len(text):
        chars = sum(map(len, words))
    else:
        data = np.frombuffer(raw, np.uint8)
        chars = int(((data & 0xC0) != 0x80).sum() - ((data == 32) | ((data >= 9) & (data <= 13))).sum())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeated_words(ids)
    data = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(data[65:91].sum()), int(data[97:123].sum()), int(data[48:58].sum())
    return (
        n, chars, symbols, dup, repeat,
        symbols / n, dup / len(lines), repeat / n, upper / max(1, upper + lower), int(data[33]) / n, digits / max(1, chars),
        float((ids[1:] == ids[:-1]).sum()) / max(1, n - 1), chars / n,
    )


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """docs' kept columns, the base counts and for each of RULES the level of its score, all under names of their own (PRIVATE)."""
    fields = [(PRIVATE + n, "bigint") for n in (*BASE, *RULES)]

    def make():
        grids = list(RULES.values())

        def count(texts):
            columns = list(zip(*map(base_counts, texts))) or [[] for _ in fields]
            at = len(BASE)
            # a score's level is how many of its rule's cutoffs it is over
            return columns[:at] + [np.searchsorted(g, np.asarray(c, float)) for g, c in zip(grids, columns[at:])]

        return count

    return map_texts(docs, keep, text, fields, make)


def base_failed():
    n = F.col(PRIVATE + "n_words")
    return (n < 20) | (100 * F.col(PRIVATE + "n_repeat_words") > 30 * n)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method; for x below about its mean."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + term * d, 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def at_most(k: int, n: int, p: float) -> float:
    """Probability that at most k of n happen, each with probability p: an incomplete beta function, whatever k is."""
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(p, b, a) / b


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest p for which at most k of n happens with a probability over `level`."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0 - 1e-12
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and at_most(k, n, mid) > level else ((low, mid) if mid > 0 else (mid, high))
    return high


def proposed(counts: dict, good_weight: float) -> dict:
    """{stratum: [(rule, index of a cutoff), ...]} from {(stratum, rule): (good by bin, bad by bin)}; bin b: over b cutoffs.

    A rule's cutoffs come from the highest down, where they meet more bad documents and enough
    to outweigh the good ones; of the rules' next cutoffs that which met fewest good documents.
    """
    chains: dict = {}
    for (stratum, rule), (good, bad) in counts.items():
        over_good, over_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
        n_good, n_bad, before = int(good.sum()), int(bad.sum()), 0
        for j in reversed(range(len(RULES[rule]))):
            g, b = int(over_good[j + 1]), int(over_bad[j + 1])
            if b > before and b / max(1, n_bad) >= good_weight * g / max(1, n_good):
                before = b
                chains.setdefault(stratum, {}).setdefault(rule, []).append((g, -b, rule, j))
    # merged, not sorted: a chain's own order stays
    return {s: [(rule, j) for *_, rule, j in heapq.merge(*of.values(), key=lambda x: (x[0], x[1], x[2]))] for s, of in chains.items()}


def first_steps(path: list) -> list[list[int]]:
    """For each of RULES and each level the number (from 1) of the first step that rejects it, len(path) + 1 if none does."""
    out = [[len(path) + 1] * (len(grid) + 1) for grid in RULES.values()]
    at = {rule: k for k, rule in enumerate(RULES)}
    for step, (rule, j) in reversed(list(enumerate(path, 1))):
        of = out[at[rule]]
        of[j + 1 :] = [min(step, x) for x in of[j + 1 :]]
    return out


def accepted(path: list, good_by_step: dict, risk: float, level: float) -> dict:
    """{rule: index of its cutoff} of the last verdict before the first that fails; good_by_step: testing documents by first step."""
    n, over, out = sum(good_by_step.values()), 0, {}
    for step, (rule, j) in enumerate(path, 1):
        over += good_by_step.get(step, 0)
        # the bound is never below the share itself
        if over > risk * n or upper_bound(over, n, level) > risk:
            break
        out[rule] = min(j, out.get(rule, j))
    return out


def calibrate(scores: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05, good_weight: float = 20.0) -> dict:
    """Indices of cutoffs by (stratum, rule) from all labelled documents; scores: counted() with doc_id and the stratum."""
    spark = scores.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__good"))
    scores = scores.where(~base_failed() & F.col(stratum).isNotNull() & F.col("doc_id").isNotNull())
    levels = [F.col(PRIVATE + r).cast("int").alias(r) for r in RULES]
    marked = scores.join(known, F.col("doc_id") == F.col("__id")).select(F.col(stratum).alias("s"), (F.col("__good") != 0).alias("good"), (crc_mod("doc_id", TUNE) == 0).alias("tune"), *levels)
    marked = stored(spark, marked, "marked")
    bins = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES]
    rows = marked.where("tune or not good").select("s", "good", F.explode(F.array(*bins)).alias("b")).groupBy("s", "b.rule", "b.bin", "good").count().collect()
    counts: dict = {}
    for s, rule, b, good, n in rows:
        both = counts.setdefault((s, rule), (np.zeros(len(RULES[rule]) + 1, np.int64), np.zeros(len(RULES[rule]) + 1, np.int64)))
        both[0 if good else 1][b] += n
    paths = proposed(counts, good_weight)
    out = {}
    if paths:
        strata = marked.select("s").distinct().count()
        steps = spark.createDataFrame([(s, first_steps(p)) for s, p in paths.items()], T.StructType([marked.schema["s"], T.StructField("steps", T.ArrayType(T.ArrayType(T.IntegerType())))]))
        first = F.least(*[F.get(F.get("steps", F.lit(k)), F.col(r)) for k, r in enumerate(RULES)])
        tested: dict = {}  # the steps are a row a stratum, which the driver has made
        for s, step, n in marked.where("good and not tune").join(F.broadcast(steps), "s").groupBy("s", first.alias("step")).count().collect():
            tested.setdefault(s, {})[step] = n
        for s, path in paths.items():
            out |= {(s, rule): j for rule, j in accepted(path, tested.get(s, {}), risk, delta / strata).items()}
    dropped(spark, marked)
    return out


def rejected(cutoffs: dict, stratum: str):
    """Whether a rule of the row's stratum rejects it."""
    out = F.lit(False)
    for (s, rule), cut in sorted(cutoffs.items()):
        out = out | ((F.col(stratum) == s) & (F.col(PRIVATE + rule) > F.lit(int(cut))))
    return F.coalesce(out, F.lit(False))


def scored(spark: SparkSession, docs: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """counted() with doc_id and the stratum (__quality_stratum), stored: texts are read once for calibrating and judging."""
    own = docs.select("doc_id", F.col(f"`{stratum}`").alias(PRIVATE + "stratum"), F.col(f"`{text}`").alias(PRIVATE + "text"))
    return stored(spark, counted(own, ["doc_id", PRIVATE + "stratum"], PRIVATE + "text"), "quality")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", **knobs) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    scores = scored(spark, docs, stratum, text)
    cutoffs = calibrate(scores, labels, PRIVATE + "stratum", **knobs)
    kept = ~base_failed() & ~rejected(cutoffs, PRIVATE + "stratum")
    return scores.select("doc_id", *[F.col(PRIVATE + b).alias(b) for b in BASE], base_failed().alias("base_failed"), kept.alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", **knobs) -> DataFrame:
    """docs without what the rules reject; the columns stay, whatever their names."""
    cutoffs = calibrate(scored(docs.sparkSession, docs, stratum, text), labels, PRIVATE + "stratum", **knobs)
    own = docs.withColumn(PRIVATE + "stratum", F.col(f"`{stratum}`")).withColumn(PRIVATE + "text", F.col(f"`{text}`"))
    out = counted(own, [*docs.columns, PRIVATE + "stratum"], PRIVATE + "text")
    return out.where(~base_failed() & ~rejected(cutoffs, PRIVATE + "stratum")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
