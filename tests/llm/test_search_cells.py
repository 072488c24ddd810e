"""The grid of cells of the exact search."""
import numpy as np
from pyspark.sql import functions as F

from skychan.llm import segment_topk
from skychan.llm.segment_topk import narrowest, top_k


def vectors(spark):
    """Two lengths, components of one to eight bytes, ties, and rows that come twice."""
    g = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.floor(g.normal(size=6 if i % 7 else 4) * 4 ** (i % 3))]) for i in range(300)]
    rows += [(i, rows[i][1]) for i in (0, 50, 51, 52)] + [(1000 + i, [2.0 ** 20 * i, 1.0, 1.0]) for i in range(50)] + [(None, [1.0]), (7, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [r for r in rows if r[0] is not None and r[1]]


def brute(rows, k):
    out = []
    for query_id in {i for i, _ in rows if i % 50 == 0}:
        pairs = sorted((-sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True)), j)
                       for i, a in rows if i == query_id for j, b in rows if j != i and len(a) == len(b))
        out += [(query_id, rank, j, -s) for rank, (s, j) in enumerate(pairs[:k], 1)]
    return sorted(out)


def test_cells_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(segment_topk, "CELL_QUERIES", 1, raising=False)
    monkeypatch.setattr(segment_topk, "CELL", 2, raising=False)
    df, rows = vectors(spark)
    out = top_k(df, F.col("vec_id") % 50 == 0, k=5, block=32, query_block=2)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 5)


def test_blocks_do_not_go_through_the_driver(spark):
    df, _ = vectors(spark)
    plan = top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_narrowest_integers():
    for x, width in (([-128, 127], 1), ([128], 2), ([-40000], 4), ([2 ** 31], 8), ([-2 ** 63, 2 ** 63 - 1], 8)):
        a = np.array(x, "<i8")
        assert narrowest(a).itemsize == width and (narrowest(a).astype("<i8") == a).all()
