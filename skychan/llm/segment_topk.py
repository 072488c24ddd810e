"""Operator 4: exact top-k search by multi-resolution segment statistics.

Components become floor(scale * x). For a segment of n components with means a, b and deviations s, t
of a query and a candidate, the segment's inner product is at most n * (a b + s t) (Cauchy-Schwarz on
what is left of the means). Summed over segments this bounds the score from above, as the segment
statistics bound a distance from below; with shorter segments the bound gets closer. The bound
itself is an inner product of (sqrt(n) a, sqrt(n) s), so a block of bounds is one matrix product.

Queries and candidates are packed into blocks of a fixed number of vectors, one row a block, in the narrowest
integers that hold them. Groups of blocks of queries and of candidates are the sides of a grid; a cell of the grid is the work
of a task, which holds its queries, meets them with one block of candidates after the other and keeps the best k of each query.
In a meeting: bounds at the coarsest resolution; the exact scores of the best k by bound set a floor for
each query; candidates whose bound is below the floor go, at this resolution and then at each
finer one; the survivors' exact scores are computed. Each cell leaves k rows a query at most,
and a ranked limit, first in each map task, leaves k. Blocks go to their cells by one shuffle and never through the driver; a
side is copied once for each group of the other.

Defined results. Vectors null, empty, or with null or non-finite components take no part, nor do rows
with null vec_id. Candidates need the query's number of components. vec_id names a row: rows that share the query's
vec_id are not its candidates; repeated rows are candidates each. Ties go to the smaller vec_id.
Fewer candidates than k: all. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychan.llm.common import written

K, SCALE = 5, 256
QUERY_BLOCK, BLOCK = 512, 2048
#: Blocks of queries and of candidates in a cell, about.
CELL_QUERIES, CELL = 32, 8
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (1, 4, 16)


def segment_bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the rows of ``x`` from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / n
    rest = x - np.repeat(mean, n, axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / n)
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([n, n]))


def meet(q: np.ndarray, q_id: np.ndarray, v: np.ndarray, v_id: np.ndarray, k: int, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best k candidates of each query, ties to the smaller id: query rows, candidate rows, scores; and how many exact scores this took."""
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    alive = q_id[:, None] != v_id[None, :]
    floor, exact = np.full(len(q), -np.inf), 0
    for segments in resolutions:
        bound = segment_bounds(qf, segments) @ segment_bounds(vf, segments).T
        bound += 1e-9 * np.abs(bound) + 1e-3  # more than the rounding: never below the true score
        bound[~alive] = -np.inf
        if len(v) > k:
            best = np.argpartition(bound, -k, axis=1)[:, -k:]
            score = np.einsum("ij,ikj->ik", qf, vf[best])
            score[np.take_along_axis(~alive, best, axis=1)] = -np.inf
            floor = np.maximum(floor, score.min(axis=1))
            exact += score.size
            alive &= bound >= floor[:, None]
    some = np.flatnonzero(alive.any(axis=1))
    left = np.flatnonzero(alive[some].any(axis=0))
    if not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), exact
    alive = alive[np.ix_(some, left)]
    exact += int(alive.sum())
    # all products and sums of them are whole numbers below 2^53: one product of matrices of floats gives them exactly
    if float(np.abs(qf).max()) * float(np.abs(vf).max()) * q.shape[1] < 2 ** 53:
        scores, none = qf[some] @ vf[left].T, -np.inf
    else:
        scores, none = q[some] @ v[left].T, np.iinfo(np.int64).min
    scores[~alive] = none
    if len(left) > k:
        alive &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]  # the best k, and what ties with the last
    qi, vi = np.nonzero(alive)
    score = scores[qi, vi].astype(np.int64)
    qi, vi = some[qi], left[vi]
    order = np.lexsort((v_id[vi], -score, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = rank < k
    return qi[keep], vi[keep], score[keep], exact


class Best:
    """The best k candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.found = [np.empty(0, np.int64) for _ in range(3)]  # query row, candidate's id, score

    def meet(self, v_id: np.ndarray, v: np.ndarray, resolutions: tuple[int, ...]) -> None:
        qi, vi, score, _ = meet(self.q.astype(np.int64), self.ids, v, v_id, self.k, resolutions)
        row, vec_id, score = (np.concatenate(x) for x in zip(self.found, (qi, v_id[vi], score), strict=True))
        order = np.lexsort((vec_id, -score, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < self.k if len(row) else []
        self.found = [row[keep], vec_id[keep], score[keep]]


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, dim, q (little-endian 64-bit integers) of the vectors that take part."""

    def pack(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, vecs = batch.column(0), batch.column(1)
            off = vecs.offsets.to_numpy().astype(np.int64)
            x = np.floor(vecs.flatten().to_numpy(zero_copy_only=False) * scale).astype("<i8")
            off = off - off[0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off).astype(np.int32)), pa.array([x[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())], ["vec_id", "dim", "q"])

    x = F.transform(F.col(vec_col).cast("array<double>"), lambda e: e)
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    part = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~bad)
    return part.mapInArrow(pack, "vec_id long, dim int, q binary")


def narrowest(x: np.ndarray) -> np.ndarray:
    low, high = x.min(), x.max()
    return x.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def blocks(vectors: DataFrame, size: int, parts: int, groups: int) -> DataFrame:
    """A row a block: dim, ids, width (bytes of a component), q (vectors), group. Made task by task from whole partitions, so no group is
    unbounded; blocks are dealt to groups in turn."""

    def fill(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, q = held.pop(dim)
            x = narrowest(np.frombuffer(b"".join(q), "<i8"))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([x.itemsize], pa.int32()),
                                               pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "width", "q"])

        for batch in it:
            for vec_id, dim, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                rows.append(q)
                if len(ids) == size:
                    yield row(dim)
        for dim in list(held):
            yield row(dim)

    made = vectors.repartition(parts, F.xxhash64("vec_id", "q")).mapInArrow(fill, "dim int, ids binary, width int, q binary")
    nth = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # partition, and place in it
    return made.withColumn("group", F.pmod(nth, F.lit(groups)).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE,
          query_block: int = QUERY_BLOCK, block: int = BLOCK, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """query_id, rank, vec_id, score of each query (``is_query`` is a condition on the column vec_id)."""
    v = written(quantised(vectors, id_col, vec_col, scale), "vectors")
    n = v.count()
    n_queries = v.filter(is_query).count()
    # all numbers of blocks, groups and cells follow the data, so the work of a cell stays the same
    q_parts, parts = max(1, -(-n_queries // query_block)), max(1, -(-n // block))
    q_groups, groups = -(-q_parts // CELL_QUERIES), -(-parts // CELL)
    q = written(blocks(v.filter(is_query), query_block, q_parts, q_groups), "query-blocks")
    c = written(blocks(v, block, parts, groups), "blocks")
    q = q.withColumn("side", F.lit(0)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.col("group") * groups + F.col("other"))
    c = c.withColumn("side", F.lit(1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1)))).withColumn("cell", F.col("other") * groups + F.col("group"))

    def best(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            for x in queries:
                qi, vec_id, score = x.found
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[qi]), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in it:
            for i in range(batch.num_rows):
                cell, dim, side, ids, width, packed = (col[i] for col in batch.columns)
                here = (cell.as_py(), dim.as_py())
                if here != at:
                    yield from rows()
                    at, queries = here, []
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                x = np.frombuffer(packed.as_buffer(), f"<i{width.as_py()}").reshape(-1, here[1])
                if side.as_py() == 0:
                    queries.append(Best(ids.copy(), x.copy(), k))
                    continue
                x = x.astype(np.int64)
                for some in queries:
                    some.meet(ids, x, resolutions)
        yield from rows()

    columns = ["cell", "dim", "side", "ids", "width", "q"]
    met = q.select(columns).unionByName(c.select(columns)).repartitionById(q_groups * groups, F.col("cell")).sortWithinPartitions("cell", "dim", "side")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(best, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
