"""Whitening of embeddings from exact covariances, by products of digit slices.

Each entry becomes an integer x. With n vectors and sums S, y = n * x - S is an integer too,
n times the centred entry, however large the entries' common offset. A task cuts its rows' y
into limbs of LIMB bits; float64 products of limb matrices of ROWS rows are sums of fewer than
2**53 and so exact. They are recombined as big integers, which tasks send on in digits of DIGIT
bits, a row a pair of dimensions; Spark sums the digits and the driver, which gets d * d numbers
whatever n is, divides by n**3 once and takes the eigenvectors.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left
out; so are those of another length than most vectors have (of equally many the shorter). An
integer beyond 2**62 is held there. Null and repeated ids and repeated vectors are rows like
others. Directions without variance (eigenvalues within rounding of 0) are no components: one
vector alone, or equal vectors, give no rows, as does an empty table. A deviation that a long
can't hold is null. A column of the table named like a new one, in any case, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored, table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LIMB, ROWS = 20, 4096  # bits and rows: 2 * 20 + 12 < 53
DIGIT = 40  # bits: sums over 2**22 tasks fit into a long
MOST = 2**62


@dataclass
class Fit:
    """n vectors with these sums; components by falling eigenvalue, vectors[:, k] of length 1."""

    n: int
    sums: list
    largest: int  # of |y|
    trace: float
    eigenvalues: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist()


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `size` finite entries, and their integers x."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(lengths == size) if size else np.empty(0, np.int64)
    c = values[(np.cumsum(lengths) - lengths)[at][:, None] + np.arange(size)]
    fine = np.isfinite(c).all(1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * c[fine]), -MOST, MOST - 2 * OFFSET).astype(np.int64) + OFFSET
    return at[fine], x


def centred(x: np.ndarray, n: int, sums: list, largest: int) -> np.ndarray:
    """n * x - S, as Python's integers where 64 bits are too few."""
    if largest < 2**62 and n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """y as count float64 matrices of LIMB bits, the lowest first; the highest has the sign."""
    out = []
    for _ in range(count - 1):
        out.append((y & (2**LIMB - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


class Gram:
    """Exact sums of y' y over blocks of rows."""

    def __init__(self, size: int, largest: int):
        self.count = -(-(largest.bit_length() + 1) // LIMB)
        self.open = np.zeros((2 * self.count - 1, size, size), np.int64)
        self.total, self.blocks = np.zeros((size, size), object), 0

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            parts = limbs(y[at : at + ROWS], self.count)
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    self.open[i + j] += (a.T @ b).astype(np.int64)
            self.blocks += 1
            if self.blocks * self.count >= 512:
                self.settle()

    def settle(self) -> np.ndarray:
        for k, part in enumerate(self.open):
            self.total += part.astype(object) << (LIMB * k)
        self.open[:], self.blocks = 0, 0
        return self.total


def _sums(df: DataFrame, vector: str) -> DataFrame:
    """size, place, n, s, low, high over all vectors of a size."""

    def run(batches):
        found: dict = {}
        for batch in batches:
            column = batch.column(0)
            for size in pc.unique(pc.fill_null(pc.list_value_length(column), 0)).to_pylist():
                _, x = matrix(column, size)
                if size and len(x):
                    # halves, as sums of whole 64-bit entries might not fit
                    s = (x >> 31).sum(0).astype(object) * 2**31 + (x & (2**31 - 1)).sum(0).astype(object)
                    n, have, low, high = found.get(size, (0, 0, x[0], x[0]))
                    found[size] = (n + len(x), have + s, np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        for size, (n, s, low, high) in found.items():
            columns = [[size] * size, list(range(size)), [n] * size, [Decimal(int(v)) for v in s], low, high]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["size", "place", "n", "s", "low", "high"])

    parts = df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(lean(run), "size int, place int, n long, s decimal(38, 0), low long, high long")
    return parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38, 0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))


def fit(spark: SparkSession, df: DataFrame, vector: str, components: int = COMPONENTS) -> Fit | None:
    """Sums and components of all vectors; None if there is no component."""
    sums = stored(spark, _sums(df, vector), "sums")
    most = sums.where("place = 0").orderBy(F.desc("n"), "size").select("size", "n").first()
    if most is None:
        return None
    size, n = most
    rows = sums.where(F.col("size") == size).orderBy("place").collect()  # a row a dimension
    s = [int(r["s"]) for r in rows]
    largest = max(max(abs(n * r["low"] - v), abs(n * r["high"] - v)) for r, v in zip(rows, s))
    digits = -(-((n * largest * largest).bit_length() + 2) // DIGIT)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def run(batches):
        gram = Gram(size, largest)
        for batch in batches:
            gram.add(centred(matrix(batch.column(0), size)[1], n, s, largest))
        total = gram.settle()
        cells = np.array([total[p] for p in pairs], object)
        columns = [pa.array(range(len(pairs)), pa.int32())]
        for _ in range(digits - 1):
            columns.append(pa.array((cells & (2**DIGIT - 1)).astype(np.int64)))
            cells = cells >> DIGIT
        columns.append(pa.array(cells.astype(np.int64)))
        yield pa.RecordBatch.from_arrays(columns, names=["cell", *[f"d{k}" for k in range(digits)]])

    parts = df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(lean(run), "cell int, " + ", ".join(f"d{k} long" for k in range(digits)))
    cells = parts.groupBy("cell").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(digits)]).collect()  # d * (d + 1) / 2 rows
    v = np.zeros((size, size))
    for r in cells:
        i, j = pairs[r["cell"]]
        v[i, j] = v[j, i] = sum(r[f"d{k}"] << (DIGIT * k) for k in range(digits)) / n**3
    e, vectors = np.linalg.eigh(v)
    e, vectors, trace = e[::-1], vectors[:, ::-1], float(np.trace(v))
    rank = int((e > size * np.finfo(float).eps * trace).sum())
    k = min(components, rank)
    return Fit(n, s, largest, trace, e[:k].copy(), vectors[:, :k].copy()) if k else None


def whiten(df: DataFrame, vector: str, made: Fit, keep: list[str] | None = None) -> DataFrame:
    """The rows that the fit counts, with deviation (long) and whitened (array<double>, a component each)."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("deviation", "whitened")]
    n, sums, largest, size = made.n, made.sums, made.largest, len(made.sums)
    turn = made.vectors / np.sqrt(made.eigenvalues)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            at, x = matrix(batch.column(batch.num_columns - 1), size)
            y = centred(x, n, sums, largest)
            if size * largest * largest >= 2**63:
                y_all = [sum(v * v for v in row) for row in y.astype(object).tolist()]
                deviation = pa.array([v if v < 2**63 else None for v in y_all], pa.int64())
            else:
                deviation = pa.array((y * y).sum(1).astype(np.int64))
            w = (y.astype(np.float64) / n) @ turn
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            own = [batch.column(i).take(pa.array(at)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, deviation, whitened], names=[*keep, "deviation", "whitened"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").alias("__vector")).mapInArrow(lean(run), schema)


def identity_error(whitened: DataFrame, made: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; they are centred, exactly but for rounding."""
    k = len(made.eigenvalues)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k * k), pa.int32()), "v": pa.array(total.ravel())})

    rows = whitened.select("whitened").mapInArrow(lean(run), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # k * k rows
    covariance = np.zeros(k * k)
    for r in rows:
        covariance[r["cell"]] = r["v"] / made.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    made = fit(spark, vectors, "embedding")
    if made is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stored(spark, whiten(vectors, "embedding", made, ["vec_id"]), "whitened")
    error = identity_error(rows, made)
    explained = F.array(*map(F.lit, made.explained))
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
