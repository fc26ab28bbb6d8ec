"""Whitening of embeddings with exact covariances.

Entries are made whole numbers first. The covariance of the different vectors is then exact:
each number, less the whole number nearest to its dimension's mean, is cut into limbs of
``LIMB`` bits, products of limb matrices are float64 GEMMs over so few rows that every sum
stays below 2^53, and the products are recombined as big integers. Tasks' matrices are cut
into digits of 32 bits, added in Spark as longs and recombined on the driver, where what the
shift left over is taken off, still in whole numbers. Only the quotients by n squared are
rounded, once, before the eigendecomposition.

The driver and the tasks hold matrices of the vectors' dimension, never rows. A table may hold
any number of copies of a vector: the distinct step combines them before it shuffles.

Rows whose vector is null, or holds null or non-finite entries, are left out, and so are those
whose length is not the commonest one (the longer of equally common ones), as vectors of other
lengths have no covariance with the rest; empty vectors are left out too. Scaled entries beyond
2^61 count as 2^61. A component without variance (more components than different vectors allow)
has the whitened value 0 and is no part of ``identity_error``. Without rows nothing is returned.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import stored

#: Bits of a limb, and rows of a product: 2 * LIMB + 13 bits are 53 at most, signed.
LIMB, ROWS, DIGIT = 19, 1 << 13, 32
MOST = 1 << 61


def quantized(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + offset as longs, for the rows that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.size(v) > 0
    fine = fine & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    rows = rows.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    near = lambda c: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), c * float(scale)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(near(c)).cast("long") + F.lit(offset).cast("long")).alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow column, all of one length, as an int64 matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as float64 matrices of signed limbs, lowest first: as many as its numbers need."""
    sign, size, out = np.sign(x).astype(np.float64), np.abs(x), []
    while True:
        out.append((size & ((1 << LIMB) - 1)).astype(np.float64) * sign)
        size = size >> LIMB
        if not size.any():
            return out


def gram(x: np.ndarray) -> dict[int, np.ndarray]:
    """x.T @ x exactly, as {power of two: int64 matrix}: products of limbs, not yet recombined."""
    total: dict[int, np.ndarray] = {}
    for low in range(0, len(x), ROWS):
        parts = limbs(x[low : low + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                # every sum is a whole number below 2 ** 53, so exact in any order
                product = (a.T @ b).astype(np.int64)
                both = product if i == j else product + product.T
                at = LIMB * (i + j)
                total[at] = total[at] + both if at in total else both
    return total


def digits(value: np.ndarray, n: int) -> list[np.ndarray]:
    """Big integers (object array) as n signed longs, the lowest of ``DIGIT`` bits first."""
    out = []
    for _ in range(n - 1):
        out.append((value & ((1 << DIGIT) - 1)).astype(np.int64))
        value = value >> DIGIT
    return [*out, value.astype(np.int64)]


#: Digits of a sum of products: 2 * 62 bits, those of a count of rows, a sign.
DIGITS, SUM_DIGITS = 6, 3


def _added(rows: DataFrame, keys: list[str], n: int) -> dict[tuple, int]:
    """Sums of digits as big integers by key; as many rows as there are keys."""
    total = rows.groupBy(*keys).agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(n)])
    return {tuple(r[k] for k in keys): sum(r[f"d{k}"] << (DIGIT * k) for k in range(n)) for r in total.collect()}


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = n = 0
        for batch in filter(len, batches):
            x = matrix(batch.column(0))
            high, low = x >> DIGIT, x & ((1 << DIGIT) - 1)
            total, n = total + (high.sum(axis=0).astype(object) << DIGIT) + low.sum(axis=0).astype(object), n + len(x)
        if n:
            # the row -1 counts vectors
            value = np.append(total, n)
            names = ["i", *[f"d{k}" for k in range(SUM_DIGITS)]]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int32()), *map(pa.array, digits(value, SUM_DIGITS))], names)

    schema = "i int, " + ", ".join(f"d{k} long" for k in range(SUM_DIGITS))
    found = _added(fit.select("x").mapInArrow(run, schema), ["i"], SUM_DIGITS)
    n = found.pop((-1,), 0)
    return n, [found[i,] for i in range(len(found))]


def scatter(fit: DataFrame, n: int, total: list[int]) -> list[list[int]]:
    """The exact matrix of sums of (n * x - S)_i (n * x - S)_j over the vectors, divided by n:
    n * sum (x - c)(x - c) - (S - n * c)(S - n * c), with c the whole number next to S / n."""
    d, center = len(total), [(2 * s + n) // (2 * n) for s in total]
    shared = fit.sparkSession.sparkContext.broadcast(np.array(center, np.int64))
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]):
        mine = np.zeros(len(upper[0]), object)
        seen = False
        for batch in filter(len, batches):
            for at, part in gram(matrix(batch.column(0)) - shared.value).items():
                mine, seen = mine + (part[upper].astype(object) << at), True
        if seen:
            arrays = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *map(pa.array, digits(mine, DIGITS))]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", *[f"d{k}" for k in range(DIGITS)]])

    schema = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
    found = _added(fit.select("x").mapInArrow(run, schema), ["i", "j"], DIGITS)
    left = [s - n * c for s, c in zip(total, center)]
    out = [[0] * d for _ in range(d)]
    for (i, j), v in found.items():
        out[i][j] = out[j][i] = n * v - left[i] * left[j]
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    #: The covariance, each entry the double next to the exact quotient.
    covariance: np.ndarray
    #: Unit eigenvectors as columns and their eigenvalues, falling.
    components: np.ndarray
    values: np.ndarray

    @property
    def center(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def left(self) -> np.ndarray:
        """What the mean is above ``center``."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.center)])

    @property
    def projection(self) -> np.ndarray:
        """Columns that whiten; zeros where a component has no variance."""
        some = self.values > 0
        return np.where(some, self.components, 0) / np.sqrt(np.where(some, self.values, 1))

    def explained(self) -> np.ndarray:
        trace = math.fsum(np.diag(self.covariance))
        return self.values / trace if trace else np.zeros(len(self.values))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # unlike a GEMM's, einsum's rounding doesn't depend on a row's place: equal vectors, equal values
        return np.einsum("ij,jk->ik", (x - self.center).astype(np.float64) - self.left, self.projection)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) squared, exactly, for each row."""
        left = [s - self.n * int(c) for s, c in zip(self.sums, self.center)]
        y = x - self.center
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * x.shape[1] < 1 << 63:
            y = y * self.n - np.array(left, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = y.astype(object) * self.n - np.array(left, object)
        return (y * y).sum(axis=1).tolist()


def fit(vectors: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening by the ``most`` first components of the stored table ``vectors`` (column
    x), each vector counted as often as it is there; None without vectors. Eigenvalues within
    rounding of zero are 0, as are those of a table with one vector."""
    n, total = sums(vectors)
    if not n:
        return None
    # whole numbers over n * n; Python's division of integers rounds once
    exact = scatter(vectors, n, total)
    v = np.array([[a / (n * n) for a in row] for row in exact])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    rank_least = len(v) * np.finfo(float).eps * max(values[0], 0.0)
    values = np.where((values > rank_least) & (np.arange(len(values)) < n - 1), values, 0.0)
    # either sign will do: the largest entry is positive
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, total, v, axes, values)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over
    components with variance. Tasks centre their own vectors before they multiply."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in filter(len, batches):
            w = shared.value(matrix(batch.column(0)))
            mean = w.mean(axis=0)
            w = w - mean
            i, j = np.indices((k, k)).reshape(2, -1)
            # of a batch: its products about its own mean, and those of its mean about zero
            both = (w.T @ w + len(w) * np.outer(mean, mean)).ravel()
            ones = np.full(k, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(k)).astype(np.int32)), pa.array(np.append(j, ones).astype(np.int32)), pa.array(np.append(both, len(w) * mean))], ["i", "j", "s"])

    rows = vectors.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k * (k + 1)
    found = {(r["i"], r["j"]): r["s"] / model.n for r in rows}
    mean = np.array([found[i, -1] for i in range(k)])
    both = np.array([[found[i, j] for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    some = np.flatnonzero(model.values > 0)
    return float(np.abs(both[np.ix_(some, some)] - np.eye(len(some))).max(initial=0.0))


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """For each row that takes part and each component up to ``most``: vec_id, component (from
    1), n, deviation DECIMAL(38, 0) (null beyond it), whitened, explained, identity_error. The
    whitening is fitted on the different vectors."""
    x = quantized(rows, vec_id, vector, scale, offset)
    different = stored(x.select("x").distinct(), "vectors")
    model = fit(different, most)
    id_type = x.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, shares, k = identity_error(different, model), model.explained(), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        of = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                x, m = matrix(part.column(1)), part.num_rows
                deviation = pa.array([v if v < 10**38 else None for v in of.deviations(x)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, of.n)), deviation.take(each), pa.array(of(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))], schema.names)

    return x.mapInArrow(run, schema)
