"""Dictionary codes and reports over open class sets against brute force."""
from collections import Counter

from skychan.operators.dictionary import encode, fit_dictionary, one_hot_sparse
from skychan.operators.metrics import confusion_cells, open_report


def test_codes_are_ranks_over_several_partitions(spark):
    values = [None if i % 40 == 0 else "hot" if i % 3 == 0 else f"c{i * 7919 % 900:03d}" for i in range(3000)]
    df = spark.createDataFrame([(v, i, "mine") for i, v in enumerate(values)], "v string, n long, category string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = fit_dictionary(df, "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks = {v: i for i, v in enumerate([*sorted({v for v in values if v is not None}), None])}
    assert {r.category: (r.code, r.n) for r in d.collect()} == {v: (ranks[v], n) for v, n in Counter(values).items()}
    got = encode(df, "v", d).collect()
    assert len(got) == 3000 and all(r.code == ranks[values[r.n]] and r.category == "mine" for r in got)
    new = spark.createDataFrame([("hot",), ("never seen",), (None,)], "v string")
    out = {r.v: r.one_hot for r in one_hot_sparse(new, "v", d, drop_last=True).collect()}
    assert out["hot"].indices == [ranks["hot"]] and out["hot"].values == [1.0] and out["hot"].size == len(ranks) - 1
    assert out["never seen"].indices == [] and out[None].indices == []     # NULL is the last code
    assert {r.v: r.code for r in encode(new, "v", fit_dictionary(df, "v", with_null=False)).collect()}[None] is None


def test_empty_dictionary(spark):
    none = spark.createDataFrame([], "v string")
    d = fit_dictionary(none, "v")
    assert d.count() == 0 and encode(none, "v", d).count() == 0
    some = one_hot_sparse(spark.createDataFrame([("a",)], "v string"), "v", d).collect()
    assert [(r.one_hot.size, r.one_hot.indices) for r in some] == [(0, [])]


def test_open_report_matches_brute_force(spark):
    pairs = [(a, b) for i in range(400) for a, b in [((None, 0, 1, 2, 77)[i * 7 % 5], (0, 1, None, -3)[i * 5 % 4])]] + [(5, 5)] * 3
    df = spark.createDataFrame(pairs, "label int, prediction int")
    cells = confusion_cells(df)
    assert {(r.label, r.prediction): r.n for r in cells.collect()} == Counter(pairs)
    rows = {r["class"]: r for r in open_report(cells).collect()}
    assert set(rows) == {c for p in pairs for c in p} and sum(r.support for r in rows.values()) == len(pairs)
    for c, r in rows.items():
        assert (r.tp, r.support, r.predicted) == (pairs.count((c, c)), sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs))
    assert (rows[5].precision, rows[5].recall, rows[5].f1_score) == (1.0, 1.0, 1.0) and rows[77].precision == 0.0
    assert open_report(confusion_cells(df.filter("false"))).count() == 0
