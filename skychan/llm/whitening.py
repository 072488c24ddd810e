"""Operator 12: whitening components of vectors by shifted CholeskyQR.

Each entry c of a vector becomes the integer x = floor(64 c) + 1,000,000. The fit list holds each distinct
x-vector once. Its n rows, centred, are the matrix Z; whitening needs the singular values and right singular
vectors of Z. Z'Z alone would square its condition number, so Z is orthogonalised in passes: the Gram
matrix of the rows is summed by Spark from the tasks' parts, its Cholesky factor R1 (of the first pass with a
small shift of the diagonal, so that it exists for nearly dependent columns too) gives Z R1^-1 by triangular solves,
which the next pass does row by row before its own Gram matrix; and so on until the Gram matrix is the identity. The
product of the factors is the R of Z = QR, to double precision, and its SVD gives
the components: eigenvalues (singular value)^2 / n of the covariance, eigenvectors the right singular vectors.

Only d x d numbers (d: the vectors' dimension) reach the driver, whatever the number of rows. Sums of integers are exact:
rows are centred about an integer near the mean before anything is multiplied.

Signs: the largest entry of each component is positive. Components with a singular value below 1e-12 of the
largest have no variance to speak of and are left out.

Defined results. Vectors that are null or hold null or non-finite entries take no part; neither do those with an entry of 2^46 or more,
which has no exact integer, and those whose length isn't the commonest one (ties: the longer). Null vec_id: a row like others.
Repeated rows: each comes out, the fit list has their vector once. All vectors equal, empty vectors or an empty
table: no components, so no rows. A deviation beyond a long is null. Other columns of the input play no part.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import written

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size and more have no exact integer.
TOO_LARGE = 2.0 ** 46
#: Rows that a task handles at once.
ROWS = 4096
#: A singular value below this share of the largest is none.
LEAST = 1e-12
#: Passes at most; three do for any matrix whose columns are independent in double precision.
MOST_PASSES = 6


@dataclass(frozen=True)
class Centre:
    """Mean of the fit list as an integer vector and an exact rest: mean = near + rest / n."""
    n: int
    near: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row."""
        y = x - self.near
        most = max(1, int(np.abs(y).max(initial=0))) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            v = self.n * y - self.rest
            return np.einsum("ij,ij->i", v, v).tolist()
        exact = (sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, self.rest, strict=True)) for row in y)
        return [v if v < 1 << 63 else None for v in exact]


def integer_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x of the vectors that take part."""
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & good)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("x")))


def matrices(it: Iterable[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in it:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centre(fit: DataFrame, d: int) -> Centre:
    """Exact sums of all dimensions, in two halves that can't overflow."""

    def partial(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in matrices(it, d):
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    rows = sorted(fit.mapInArrow(partial, "i long, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect())  # a row a dimension
    n, total = rows[0].n, [(r.high << 26) + r.low for r in rows]
    near = [(2 * s + n) // (2 * n) for s in total]
    return Centre(n, np.array(near, np.int64), np.array([s - n * m for s, m in zip(total, near, strict=True)], np.int64))


def solved(z: np.ndarray, r: np.ndarray) -> np.ndarray:
    """z r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(z)
    for j in range(r.shape[0]):
        q[:, j] = (z[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, d: int, about: Centre, factors: list[np.ndarray], last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the centred rows after the triangular solves with ``factors`` (and a product with ``last``)."""
    k = d if last is None else last.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((about, factors, last))  # a few matrices of d x d
    up, right = np.triu_indices(k)

    def partial(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rs, w = shared.value
        g, s, n = np.zeros((k, k)), np.zeros(k), 0
        for _, x in matrices(it, d):
            z = own.of(x)
            for r in rs:
                z = solved(z, r)
            z = z if w is None else z @ w
            g, s, n = g + z.T @ z, s + z.sum(0), n + len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[up, np.full(k, -1)]), pa.array(np.r_[right, np.arange(k)]), pa.array(np.r_[g[up, right], s])], ["i", "j", "v"])

    rows = fit.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d (d + 3) / 2 numbers
    i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "v"))
    g, s = np.zeros((k, k)), np.zeros(k)
    s[j[i < 0]] = v[i < 0]
    i, j, v = i[i >= 0], j[i >= 0], v[i >= 0]
    g[i, j], g[j, i] = v, v
    return g, s


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g + shift I; a shift that is too small for g grows."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(g) * np.finfo(float).eps * np.trace(g))


def triangle(fit: DataFrame, d: int, about: Centre) -> np.ndarray:
    """R of the centred fit list's QR: the product of the factors of all passes."""
    factors: list[np.ndarray] = []
    for turn in range(MOST_PASSES):
        g, _ = gram(fit, d, about, factors)
        if turn == 0 and not np.trace(g) > 0:
            return np.zeros((d, d))
        if turn > 1 and np.abs(g - np.diag(np.diag(g))).max() < 1e-10 and np.minimum(abs(np.diag(g) - 1), abs(np.diag(g))).max() < 1e-10:
            break
        factors.append(factor(g, 11 * d * (d + 1) * np.finfo(float).eps * np.trace(g) if turn == 0 else 0.0))
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    return r


def whitened(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    rows = integer_vectors(table, id_col, vec_col)
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most.d == 0:
        return spark.createDataFrame([], schema)
    d = most.d
    rows = rows.filter(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "fit-list")
    about = centre(fit, d)
    _, sigma, v = np.linalg.svd(triangle(fit, d, about))
    k = min(components, d, int((sigma > LEAST * sigma[0]).sum()) if sigma[0] > 0 else 0)
    if not k:
        return spark.createDataFrame([], schema)
    v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(1)])[:, None]
    explained = sigma[:k] ** 2 / (sigma ** 2).sum()
    onto = v.T / (sigma[:k] / np.sqrt(about.n))
    g, s = gram(fit, d, about, [], onto)
    error = float(np.abs(g / about.n - np.outer(s, s) / about.n ** 2 - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((about, onto, explained))  # a matrix of d x components

    def project(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, share = shared.value
        for batch, x in matrices(it, d):
            m = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(own.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), deviation,
                                              pa.array((own.of(x) @ w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(project, schema)
