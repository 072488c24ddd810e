"""As-of join and rollup with exact distinct counts: ties, NULLs, hot keys, partitions, empty tables."""
import random

import pytest

from skychan.operators.asof import asof_join
from skychan.operators.rollup import distinct_rollup, grouping_sets


def brute_asof(left, right, strict):
    out = []
    for k, t, i in left:
        best = None
        for rk, rt, tie, v in right:
            if t is None or rt is None or rk != k or not (rt < t or (not strict and rt == t)):
                continue
            if best is None or (rt, tie is not None, tie or 0) > (best[0], best[1] is not None, best[1] or 0):
                best = (rt, tie, v)
        out.append((k, t, i, best and best[0], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("partitions", [1, 7])
def test_asof(spark, strict, partitions):
    r = random.Random(4)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(key(), r.choice([None, *range(40)]), i) for i in range(300)]
    seen, right = set(), []
    for i in range(300):     # several rows at one time, told apart by the tie
        k, t = key(), r.choice([None, *range(40)])
        if t is None or (k, t, i % 5) not in seen:
            seen.add((k, t, i % 5))
            right.append((k, t, None if i % 5 == 0 else i % 5, f"v{i}"))
    left.append(left[0])
    a = spark.createDataFrame(left, "k string, t int, i int").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, tie int, v string").repartition(5)
    got = asof_join(a, b, ["k"], "t", "tie", ["v"], strict=strict, partitions=partitions)
    assert got.columns == ["k", "t", "i", "last_t", "last_v"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_asof(left, right, strict)
    assert asof_join(a, b.filter("false"), ["k"], "t", "tie", ["v"]).filter("last_t IS NULL").count() == len(left)
    assert asof_join(a.filter("false"), b, ["k"], "t", "tie", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b, ["k"], "t", "tie", ["v"], prefix="")


def test_asof_of_one_hot_key_lies_in_many_partitions(spark):
    """All rows have one key: every partition gets a share of them, and carries cross the cuts."""
    df = spark.range(4000).selectExpr("'one' AS k", "id AS t", "id AS i")
    got = asof_join(df, df.filter("i % 1000 = 0"), ["k"], "t", "i", ["i"], partitions=8)
    assert got.filter("last_i != floor((t - 1) / 1000) * 1000 OR (t > 0 AND last_i IS NULL)").count() == 0
    assert got.count() == 4000


@pytest.mark.parametrize("kind", ["cube", "rollup"])
def test_distinct_rollup(spark, kind):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, -5, -40_000, 0, 32_767, 32_768, 2 ** 40, r.randrange(200_000)]), r.randrange(10)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b int, id bigint, w int").repartition(5)
    got = {(x.level, x.a, x.b): (x.n, x.n_distinct, x.w) for x in distinct_rollup(df, ["a", "b"], "id", {"w": df["w"]}, kind=kind).collect()}
    want = {}
    for s in grouping_sets(["a", "b"], kind):
        level = 2 * ("a" not in s) + ("b" not in s)
        groups = {}
        for a, b, i, w in rows:
            groups.setdefault((level, a if "a" in s else None, b if "b" in s else None), []).append((i, w))
        for g, v in groups.items():
            want[g] = (len(v), len({i for i, _ in v if i is not None}), sum(w for _, w in v))
    assert got == want
    none = distinct_rollup(df.filter("false"), ["a", "b"], "id", kind=kind).collect()
    assert [(x.level, x.n, x.n_distinct) for x in none] == [(3, 0, 0)]
    with pytest.raises(ValueError):
        distinct_rollup(df, ["b"], "a")
