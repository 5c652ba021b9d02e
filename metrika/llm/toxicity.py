"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Training: a bounded sample of labelled documents gives, for n-grams of 2 to 6 lower-cased
characters (code points), the log ratio r of their smoothed document counts under the two
labels. N-grams whose shares differ clearly (`min_z` of the two-proportion test, the `most`
clearest) are kept, and numpy fits a logistic regression to the features 1{present} * r, as an
NB-SVM does; the intercept is corrected from the sample's share of toxic documents to that of
all learnt labels. An n-gram is known by a 64-bit hash of its code points.

Bound of the sample: `per_class` documents of each label (smallest hash of their ids; of a
repeated id up to four texts on average), whole up to `max_chars` characters, of longer ones as
many characters in slices from all over the text. The shares of labels are counted over all
rows; scoring reads every whole text. Defined cases: null and empty texts have no n-gram, so
the prior is their score; without both labels nothing is learnt and every score is the
(smoothed) prior; of several labels of a doc_id the highest counts; documents with a null id
aren't learnt from, are scored like any other and have a null held_out; a score of exactly 0.5
is predicted 1; repeated rows each count; an empty table gives no rows; a kept column of the
name of a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, table

GRAMS = (2, 3, 4, 5, 6)
TABLE_BITS = 20
SLICES = 20
PARTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams_of(text: str | None) -> list[np.ndarray]:
    """For each of GRAMS the hashes of all n-grams of the text's characters, in order."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, state = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        state = (state[: len(codes) - n + 1] ^ (codes[n - 1 :] + np.uint64(n << 32))) * _ODD
        state ^= state >> np.uint64(31)
        if n in GRAMS:
            out.append(state)
    return out


def packed(text: str | None) -> np.ndarray:
    """Distinct n-grams of the text."""
    out = grams_of(text)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * _ODD) >> np.uint64(64 - TABLE_BITS)


class Model:
    """Kept n-grams, their weights (r times the fitted coefficient) and the intercept."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias

    def prepare(self) -> None:
        order = np.argsort(self.grams)
        self.grams, self.weights = self.grams[order], self.weights[order]
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[_slots(self.grams)] = True

    def score(self, text: str | None) -> float:
        """Probability of the toxic label. The table of slots only spares look-ups; each n-gram is compared in full."""
        total = self.bias
        if len(self.grams):
            hits = [g[self.maybe[_slots(g)]] for g in grams_of(text)]
            if hits:
                found = np.unique(np.concatenate(hits))
                at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
                total += float(self.weights[at[self.grams[at] == found]].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -40, 40))))


def fit(texts: list, labels: list, prior: float, min_z: float = 5.0, most: int = 3000, rounds: int = 400, l2: float = 1e-4) -> Model:
    """prior: share of toxic labels among all that may be learnt from."""
    bias = float(np.log(prior / (1 - prior)))
    y = np.asarray(labels, float)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    nothing = Model(np.empty(0, np.uint64), np.empty(0), bias)
    if not n_pos or not n_neg:
        return nothing
    sets = [packed(t) for t in texts]
    found = []
    for k in range(PARTS):  # by ranges of the hash, so that not all n-grams are counted at once
        bounds = np.array([k, k + 1], np.uint64) << np.uint64(64 - PARTS.bit_length() + 1)
        own = [s[slice(*np.searchsorted(s, bounds))] if k + 1 < PARTS else s[np.searchsorted(s, bounds[0]) :] for s in sets]
        every, inverse = np.unique(np.concatenate(own), return_inverse=True)
        pos = np.bincount(inverse, np.repeat(y, [len(s) for s in own]), len(every))
        neg = np.bincount(inverse, minlength=len(every)) - pos
        share = (pos + neg) / len(y)
        z = np.abs((pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_pos + 1 / n_neg)))
        kept = z >= min_z
        found.append((every[kept], pos[kept], neg[kept], z[kept]))
    every, pos, neg, z = (np.concatenate(c) for c in zip(*found))
    kept = np.sort(np.argsort(-z, kind="stable")[:most])
    every, pos, neg = every[kept], pos[kept], neg[kept]
    if not len(every):
        return nothing
    r = np.log((pos + 1) / (n_pos + 1)) - np.log((neg + 1) / (n_neg + 1))
    hits = [np.flatnonzero(np.isin(every, s, assume_unique=True)) for s in sets]
    rows, cols = np.repeat(np.arange(len(y)), [len(h) for h in hits]), np.concatenate(hits)
    sample_bias = np.log(n_pos / n_neg)
    w, m, s = np.zeros(len(every) + 1), np.zeros(len(every) + 1), np.zeros(len(every) + 1)  # last: the intercept
    for i in range(1, rounds + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * r[cols], len(y)) + w[-1], -40, 40)))
        error = (p - y) / len(y)
        g = np.append(np.bincount(cols, error[rows] * r[cols], len(every)) + l2 * w[:-1], error.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (1 - 0.9 * i / rounds) * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-10)
    return Model(every, w[:-1] * r, float(w[-1] - sample_bias + bias))


def sliced(text: Column, most: int) -> Column:
    """The text, or of a longer one as many characters in SLICES slices from its beginning to its end."""
    size, n = most // SLICES, F.length(text)
    slices = [F.substring(text, F.floor((n - size) * i / (SLICES - 1)).cast("int") + 1, F.lit(size)) for i in range(SLICES)]
    return F.when(n <= most, text).otherwise(F.concat_ws(" ", *slices))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = 800, max_chars: int = 20_000, **knobs) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("__toxic"))
    sizes = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    order = [F.xxhash64("__id"), "__id"]
    picked = known.where("__toxic = 1").orderBy(*order).limit(per_class).unionByName(known.where("__toxic = 0").orderBy(*order).limit(per_class))
    rows = (
        docs.select(F.col("doc_id").alias("__doc"), F.col(f"`{text}`").alias("__text"))
        .join(F.broadcast(picked), F.col("__doc") == F.col("__id"))  # 2 * per_class rows at most
        .where("__text is not null").select("__id", "__toxic", sliced(F.col("__text"), max_chars).alias("__text"))
        .orderBy("__id", "__text").limit(4 * per_class).collect()
    )
    return fit([r["__text"] for r in rows], [r["__toxic"] for r in rows], prior, **knobs)


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    def make():
        model.prepare()

        def run(texts):
            scores = [model.score(t) for t in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return run

    return map_texts(docs, keep, text, [("score", "double"), ("predicted", "int")], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    out = score_documents(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
