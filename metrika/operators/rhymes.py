"""Which tails of a vocabulary rhyme, without comparing all pairs.

Groups of rhymes need links that join what all pairs would join, not all pairs. Tails that
share much (all nuclei and a coda, all but one nucleus, all but the first syllable, one whole
syllable in its place) are offered to each other, each to two of its block; what reaches the
threshold is linked. Rounds of offers leave a few tails outside the main group of their length.
Only for these partners are looked up, by an index of nuclei in their places: where that would
be many pairs a tail, first in samples, which leave those that rhyme with little, then in all.
Many pairs are scored at once, by arrays of pairs with tails of the same lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrika.functions import tables as T
from metrika.operators import kernel
from metrika.operators.components import connected_components, settled
from metrika.operators.g2p import small

ROUNDS = 2
SALTS = 8
SLACK = 1e-9  # scores are compared after rounding to 9 digits
SYLLABLES = 1 << 18  # of the pairs that are aligned at once
MOST_PAIRS, SAMPLE_PAIRS = 16, 2  # for each tail of all: pairs that are looked up at once, and those of a sample
PROBES = 20_000  # so many are joined by broadcast


def block_keys(t: Column) -> Column:
    """Keys (longs) under which a coded tail meets others; equal keys only make an offer, so a clash of hashes does no harm."""
    places = F.sequence(F.lit(0), F.size(t) - 1)
    nuclei = F.transform(t, lambda s: s["v"])
    codas = F.transform(t, lambda s: s["c"])
    but = lambda i: F.transform(nuclei, lambda v, k: F.when(k == i, -1).otherwise(v))
    kinds = [
        F.transform(places, lambda i: F.xxhash64(F.lit("coda"), nuclei, i, F.get(codas, i))),
        F.transform(places, lambda i: F.xxhash64(F.lit("nucleus"), but(i), codas)),
        F.transform(places, lambda i: F.xxhash64(F.lit("next"), but(i), i, F.get(codas, (i + 1) % F.size(t)))),
        F.transform(places, lambda i: F.xxhash64(F.lit("syllable"), F.size(t), i, F.get(nuclei, i), F.get(codas, i))),
        F.array(F.xxhash64(F.lit("end"), F.slice(nuclei, 2, F.size(t)), F.slice(codas, 2, F.size(t))), F.xxhash64(F.lit("end"), nuclei, codas)),
        # nearly all tails of one syllable rhyme with what has the same nucleus and begins its coda with the same sound
        F.array(F.xxhash64(F.lit("first"), nuclei, F.transform(codas, lambda c: F.get(c, F.lit(0))))),
    ]
    return F.array_distinct(F.concat(*kinds))


#: By turn: a number that ids are combined with, so that another member of a block is the least.
MASKS = [0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D]


def offers(tails: DataFrame, turn: int) -> DataFrame:
    """Pairs a, b (ids) and their tails t1, t2 of different groups: each open tail and two of each of its blocks, in the first turn one.

    tails: id, t, component, open. turn: which members a block offers. Only ids are dealt out by
    block; a pair gets its tails when it is known once.
    """
    mixed = F.col("id").bitwiseXOR(F.lit(MASKS[turn % len(MASKS)]))
    keyed = tails.select("open", mixed.alias("a"), F.explode(block_keys(F.col("t"))).alias("key"))
    members = keyed.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most"))
    offered = F.explode(F.array("least", "most")) if turn else F.col("least")
    pairs = keyed.where("open").join(members, "key").select("a", offered.alias("b")).where("a <> b").distinct()
    back = lambda c: F.col(c).bitwiseXOR(F.lit(MASKS[turn % len(MASKS)])).alias(c)
    end = lambda c, t, g: tails.select(F.col("id").alias(c), F.col("t").alias(t), F.col("component").alias(g))
    return pairs.select(back("a"), back("b")).join(end("a", "t1", "component"), "a").join(end("b", "t2", "other"), "b").where("component <> other")


def thinned(links: DataFrame) -> DataFrame:
    """Of the links (a, b, component, other) of each a those with the least and the largest b."""
    ends = links.groupBy("a", "component").agg(F.min("b").alias("b0"), F.min_by("other", "b").alias("o0"), F.max("b").alias("b1"), F.max_by("other", "b").alias("o1"))
    both = F.explode(F.array(F.struct(F.col("b0").alias("b"), F.col("o0").alias("other")), F.struct(F.col("b1").alias("b"), F.col("o1").alias("other"))))
    return ends.select("a", "component", both.alias("e")).select("a", "e.b", "component", "e.other").distinct()


def most_gaps(m: Column, n: Column, threshold: float) -> Column:
    """Columns with one side only that an alignment of m and n syllables may have."""
    return F.floor((m + n) * ((1 - threshold) / (1 + threshold)) + SLACK).cast("int")


def _lengths(n: Column, threshold: float) -> Column:
    """Lengths of tails that can rhyme with one of n syllables."""
    return F.sequence(F.greatest(F.ceil(n * threshold - SLACK), F.lit(1)).cast("int"), F.floor(n / threshold + SLACK).cast("int"))


def near_nuclei(threshold: float, nucleus_weight: float, coda_weight: float) -> list[list[int]]:
    """For each nucleus those with which a column can reach the threshold, its codas being equal."""
    n, least = len(T.VOWELS), (threshold * (nucleus_weight + coda_weight) - coda_weight) / nucleus_weight - SLACK
    return [[b for b in range(n) if 1.0 - T.VOWEL_DISTANCES[a * n + b] >= least] for a in range(n)]


def candidates(probes: DataFrame, tails: DataFrame, threshold: float, nucleus_weight: float = kernel.NUCLEUS_WEIGHT, coda_weight: float = kernel.CODA_WEIGHT) -> DataFrame:
    """Distinct pairs (a, b) of a probe's and a tail's id that may reach the threshold; none that does is missing.

    A mean that reaches the threshold has a column that does, in places that differ by no more
    than the alignment has gaps; so both sides meet on (length, place, nucleus). Postings are salted.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    near = F.array(*[F.array(*map(F.lit, row)) for row in near_nuclei(threshold, nucleus_weight, coda_weight)])
    m = F.size("t")
    asked = probes.select("id", "t", m.alias("m"), F.explode(_lengths(m, threshold)).alias("n")).withColumn("gaps", most_gaps(F.col("m"), F.col("n"), threshold))
    asked = asked.select("id", "n", "gaps", F.posexplode("t").alias("i", "s"))
    places = F.sequence(F.greatest(F.col("i") - F.col("gaps"), F.lit(0)), F.least(F.col("i") + F.col("gaps"), F.col("n") - 1))
    asked = asked.where(F.col("i") - F.col("gaps") <= F.col("n") - 1).select("id", "n", F.explode(places).alias("place"), "s")
    asked = asked.select(F.col("id").alias("a"), "n", "place", F.explode(F.get(near, F.col("s.v"))).alias("nucleus")).distinct()
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    postings = tails.select(F.col("id").alias("b"), F.size("t").alias("n"), F.posexplode("t").alias("place", "s"))
    postings = postings.select("b", "n", "place", F.col("s.v").alias("nucleus"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = asked.join(postings, ["n", "place", "nucleus", "salt"]).where("a <> b")
    return pairs.select("a", "b").distinct()


def with_tails(pairs: DataFrame, tails: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) with their tails t1, t2. probes: those of a; few probes have many pairs each, which aren't dealt out by the probe."""
    end = lambda df, c, t: df.select(F.col("id").alias(c), F.col("t").alias(t))
    first = end(tails, "a", "t1") if probes is None else small(end(probes, "a", "t1"), PROBES)
    return pairs.join(first, "a").join(end(tails, "b", "t2"), "b")


def coda_table(codas: list[list[int]]) -> np.ndarray:
    """Similarity of all pairs of codas: what Codas finds for the pairs asked for, for few codas."""
    width, n = max(map(len, codas), default=0), len(T.CONSONANTS)
    grid = np.full((len(codas), max(width, 1)), n)
    for row, c in zip(grid, codas):
        row[: len(c)] = c
    alike = np.zeros((n + 1, n + 1))
    alike[:n, :n] = 1.0 - np.array(T.CONSONANT_DISTANCES).reshape(n, n)
    length = np.array(list(map(len, codas)))
    longer = np.maximum(length[:, None], length[None, :])
    total = np.zeros((len(codas), len(codas)))
    for k in range(width):
        total = total + alike[grid[:, k][:, None], grid[:, k][None, :]]
    return np.where(longer == 0, 1.0, total / np.maximum(longer, 1))


class Codas:
    """Codas by their places in a batch, similarity of pairs of which is found when asked for.

    A batch over a large vocabulary has thousands of different codas; a table of all their pairs would
    take more memory than the batch, growing with the square of their number.
    """

    def __init__(self, flat: np.ndarray, length: np.ndarray):
        n = len(T.CONSONANTS)
        self.flat, self.length, self.start = flat, length, np.cumsum(length) - length
        self.alike = np.zeros((n + 1, n + 1))
        self.alike[:n, :n] = 1.0 - np.array(T.CONSONANT_DISTANCES).reshape(n, n)

    def __getitem__(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x, y = np.broadcast_arrays(*pair)
        both, longer = np.minimum(self.length[x], self.length[y]), np.maximum(self.length[x], self.length[y])
        total, k, at = np.zeros(x.shape), 0, np.nonzero(both)
        while len(at[0]):
            total[at] += self.alike[self.flat[self.start[x[at]] + k], self.flat[self.start[y[at]] + k]]
            k += 1
            more = both[at] > k
            at = tuple(i[more] for i in at)
        return np.where(longer == 0, 1.0, total / np.maximum(longer, 1))


def align_many(v1: np.ndarray, v2: np.ndarray, c1: np.ndarray, c2: np.ndarray, w1: np.ndarray, w2: np.ndarray, codas: Codas, nucleus_weight: float, coda_weight: float, gap: float) -> tuple:
    """Score, columns and informative columns of pairs of tails, a row a pair: nuclei v, places of codas c, bare schwas w; as kernel.align() has them."""
    n = len(T.VOWELS)
    distances = np.array(T.VOWEL_DISTANCES).reshape(n, n)
    rows, width = len(v1), v2.shape[1]
    zero = np.zeros(rows, np.int64)
    before = [(np.full(rows, j * gap), np.zeros(rows), zero + j, zero) for j in range(width + 1)]
    for i in range(v1.shape[1]):
        row = [(np.full(rows, (i + 1) * gap), np.zeros(rows), zero + i + 1, zero)]
        for j in range(width):
            corner, up, left = before[j], before[j + 1], row[j]
            d = distances[v1[:, i], v2[:, j]]
            similarity = (nucleus_weight * (1.0 - d) + coda_weight * codas[c1[:, i], c2[:, j]]) / (nucleus_weight + coda_weight)
            cost, up_cost, left_cost = corner[0] + d, up[0] + gap, left[0] + gap
            takes_up = up_cost < cost - kernel.TIE
            takes_left = left_cost < np.where(takes_up, up_cost, cost) - kernel.TIE
            pick = lambda a, b, c: np.where(takes_left, c, np.where(takes_up, b, a))
            row.append((pick(cost, up_cost, left_cost), pick(corner[1] + similarity, up[1], left[1]), pick(corner[2], up[2], left[2]) + 1, pick(corner[3] + ~(w1[:, i] & w2[:, j]), up[3], left[3])))
        before = row
    _, total, columns, informative = before[-1]
    return total / np.maximum(columns, 1), columns, informative


def _codas(lists: list[pa.Array]) -> tuple[list[np.ndarray], Codas]:
    """For columns of codas: the places of each in Codas."""
    length = np.concatenate([c.value_lengths().to_numpy() for c in lists])
    flat = np.concatenate([c.flatten().to_numpy() for c in lists])
    return np.split(np.arange(len(length)), [len(lists[0])]), Codas(flat, length.astype(np.int64))


def _scores(t1: pa.Array, t2: pa.Array, nucleus_weight: float, coda_weight: float, gap: float) -> tuple:
    """Scores, columns and informative columns of two columns of tails."""
    n1, n2 = (t.value_lengths().to_numpy() for t in (t1, t2))
    syllables = [t.flatten() for t in (t1, t2)]
    places, table = _codas([s.field("c") for s in syllables])
    nuclei = [s.field("v").to_numpy() for s in syllables]
    bare = [s.field("w").to_numpy(zero_copy_only=False) for s in syllables]
    start = [np.cumsum(n) - n for n in (n1, n2)]
    out = np.zeros(len(n1)), np.zeros(len(n1), np.int64), np.zeros(len(n1), np.int64)
    kinds = n1.astype(np.int64) * (int(n2.max(initial=0)) + 1) + n2
    for kind in np.unique(kinds):
        every = np.flatnonzero(kinds == kind)
        m, n = int(n1[every[0]]), int(n2[every[0]])
        if not m or not n:
            continue
        for at in np.array_split(every, len(every) * (m + n) // SYLLABLES + 1):
            x, y = start[0][at][:, None] + np.arange(m), start[1][at][:, None] + np.arange(n)
            made = align_many(nuclei[0][x], nuclei[1][y], places[0][x], places[1][y], bare[0][x], bare[1][y], table, nucleus_weight, coda_weight, gap)
            for column, values in zip(out, made):
                column[at] = values
    return out


def reaching(pairs: DataFrame, threshold: float, nucleus_weight: float = kernel.NUCLEUS_WEIGHT, coda_weight: float = kernel.CODA_WEIGHT, gap: float = kernel.GAP, counts: bool = False) -> DataFrame:
    """The pairs (with tails t1, t2 and any long columns) whose score reaches the threshold: these columns and the score, rounded to 9 digits.

    counts: the alignment's columns and informative columns too.
    """
    keep = [c for c in pairs.columns if c not in ("t1", "t2")]
    more = ["columns", "informative"] if counts else []

    def run(batches):
        for batch in batches:
            made = _scores(batch.column(0), batch.column(1), nucleus_weight, coda_weight, gap)
            near = pa.array(np.flatnonzero(made[0] >= threshold - 2 * SLACK))
            own = [batch.column(2 + i) for i in range(len(keep))] + [pa.array(made[0])] + [pa.array(m.astype(np.int32)) for m in made[1:]] * counts
            yield pa.RecordBatch.from_arrays([c.take(near) for c in own], names=[*keep, "score", *more])

    kinds = [*[f"{c} long" for c in keep], "score double", *[f"{c} int" for c in more]]
    found = pairs.select("t1", "t2", *keep).mapInArrow(run, ", ".join(kinds))
    return found.withColumn("score", F.round("score", 9)).where(F.col("score") >= threshold)


def rhyming_pairs(probes: DataFrame, tails: DataFrame, threshold: float = kernel.THRESHOLD, **weights) -> DataFrame:
    """(a, b, score): all tails that a probe rhymes with; probes and tails: id, t."""
    own = {k: v for k, v in weights.items() if k in ("nucleus_weight", "coda_weight")}
    return reaching(with_tails(candidates(probes, tails, threshold, **own), tails, probes), threshold, **weights).select("a", "b", "score")


def grouped(tails: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """tails (id, t, component) with the components that links between components make, and which are open.

    A length's main group is the one that has most of its tails. A tail is open if it isn't in
    its length's; so are all tails of a length if another length, with more tails, that can
    rhyme with it has another main group. Of two tails of different groups that may rhyme one is open.
    """
    scope = F.lit(0).alias("scope")
    found = connected_components(tails.select(scope, F.col("component").alias("node")), links.select(scope, F.col("component").alias("a"), F.col("other").alias("b")))
    joined = settled(tails.select("id", "t", F.col("component").alias("node")).join(found.select("node", "component"), "node").select("id", "t", F.size("t").alias("n"), "component"))
    size = joined.groupBy("n", "component").agg(F.count("*").alias("k"))
    main = size.groupBy("n").agg(F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("m"), F.sum("k").alias("all"))
    main = settled(main.select("n", (-F.col("m.c")).alias("main"), "all"))  # a row a length
    near = main.select("n", "main", "all", F.explode(_lengths(F.col("n"), threshold)).alias("o"))
    other = main.select(F.col("n").alias("o"), F.col("main").alias("other"), F.col("all").alias("rest"))
    clash = near.join(other, "o").where("main <> other and (all < rest or (all = rest and n < o))").select("n", F.lit(True).alias("clash")).distinct()
    state = joined.join(F.broadcast(main.join(clash, "n", "left")), "n")
    return settled(state.select("id", "t", "component", ((F.col("component") != F.col("main")) | F.coalesce("clash", F.lit(False))).alias("open")))


def possible(state: DataFrame, threshold: float) -> tuple[int, int]:
    """How many tails there are, and how many pairs the open ones make with all tails of lengths that can rhyme with theirs."""
    size = settled(state.groupBy(F.size("t").alias("n")).agg(F.count("*").alias("all"), F.count_if("open").alias("open")))  # a row a length
    asked = size.select("open", F.explode(_lengths(F.col("n"), threshold)).alias("n")).join(size.select("n", "all"), "n")
    return size.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0], asked.agg(F.coalesce(F.sum(F.col("open") * F.col("all")), F.lit(0))).first()[0]


def looked_up(state: DataFrame, among: DataFrame, threshold: float, weights: dict) -> DataFrame:
    """(a, b, component, other): a link of each open tail to each other group with a tail of `among` that it rhymes with."""
    probes = state.where("open")
    found = rhyming_pairs(probes.select("id", "t"), among.select("id", "t"), threshold, **weights)
    links = found.join(among.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy("a", "other").agg(F.min("b").alias("b"))
    links = links.join(probes.select(F.col("id").alias("a"), "component"), "a")
    return settled(links.where("component <> other").select("a", "b", "component", "other"))


def _joined(tails: DataFrame, threshold: float, weights: dict) -> tuple[list, DataFrame, DataFrame]:
    """Links (a, b) of the rounds of offers and samples, what they make (grouped()), and looked_up() in all tails.

    Any part of the links will do in a round: what it leaves apart is open, and all that an open tail rhymes with is looked up.
    """
    state = settled(tails.select("id", "t", F.col("id").alias("component"), F.lit(True).alias("open")))
    links = []
    for turn in range(ROUNDS):
        made = reaching(offers(state, turn), threshold, **weights).select("a", "b", "component", "other")
        made = settled(made if turn else thinned(made))
        if made.isEmpty():
            break
        links.append(made.select("a", "b"))
        state = grouped(state, made, threshold)
    n, pairs = possible(state, threshold)
    while pairs > MOST_PAIRS * n:
        # most open tails rhyme with a share of all, and so with one of the sample
        share = pairs // (SAMPLE_PAIRS * n) + 1
        made = looked_up(state, state.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), threshold, weights)
        links.append(made.select("a", "b"))
        state, before = grouped(state, made, threshold), pairs
        _, pairs = possible(state, threshold)
        if 2 * pairs > before:
            break
    return links, state, looked_up(state, state, threshold, weights)


def tail_links(tails: DataFrame, threshold: float = kernel.THRESHOLD, **weights) -> DataFrame:
    """(a, b): links of tails (id, t; distinct) that reach the threshold and join what all such links would join."""
    if threshold > 1:
        return tails.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    links, _, rest = _joined(tails, threshold, weights)
    out = rest.select("a", "b")
    for more in links:
        out = out.unionByName(more)
    return out


def tail_groups(tails: DataFrame, threshold: float = kernel.THRESHOLD, **weights) -> DataFrame:
    """(id, component): groups that all links of tails (id, t; distinct) would make; the last links are joined between groups, which are few."""
    if threshold > 1:
        return tails.select("id", F.col("id").alias("component"))
    _, state, rest = _joined(tails, threshold, weights)
    scope = F.lit(0).alias("scope")
    between = rest.select(scope, F.col("component").alias("a"), F.col("other").alias("b"))
    found = connected_components(state.select(scope, F.col("component").alias("node")), between)
    return settled(state.select("id", F.col("component").alias("node")).join(found.select("node", "component"), "node").select("id", "component"))
