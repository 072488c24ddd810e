"""Queries that write the whole table as text hold the text of a piece of it at a time, and give the same rows."""
import gzip

import pytest
from pyspark.sql import functions as F

from skychan.plans import fixture, queries
from tests.conftest import SF_SMALL
from tests.test_bounded_tasks import files, made


def texts(prefixes):
    """Rows of text left behind."""
    out = 0
    for path in prefixes:
        for f in files(path):
            if ".csv" in f:
                with (gzip.open if f.endswith(".gz") else open)(f, "rt") as lines:
                    out += sum(1 for _ in lines) - 1
    return out


def same_rows(a, b):
    columns = sorted(a.columns)
    rows = [sorted(map(str, df.select(*columns).collect())) for df in (a, b)]
    return rows[0] == rows[1]


@pytest.mark.parametrize("query, prefix, copies", [
    ("ingest_mixed", "mixed-src", 4 / 3), ("load_union", "parts", 3), ("ingest_rejects", "rejects-src", 1), ("ingest_stream", "stream-src", 1),
    ("decode_roundtrip", "observations-", 1),
])
def test_text_of_a_piece_at_a_time(spark, monkeypatch, query, prefix, copies):
    n = fixture.read_table(spark, SF_SMALL, "orders").count()
    whole = queries.QUERIES[query](spark, SF_SMALL).persist()
    whole.count()
    monkeypatch.setattr(fixture, "PIECE_ROWS", n // 3, raising=False)
    before, pieces = made(spark, prefix), made(spark, "order-pieces")
    out = queries.QUERIES[query](spark, SF_SMALL)
    assert 0 < texts(made(spark, prefix) - before) <= 0.5 * copies * n
    assert made(spark, "order-pieces") == pieces
    assert same_rows(whole, out)


def test_pieces_hold_each_row_once(spark, monkeypatch, tmpdir_path):
    """Also rows that come several times and rows without a key."""
    rows = [(1, 1)] * 50 + [(None, 2)] * 50 + [(i, i) for i in range(100)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(tmpdir_path + "/orders.parquet")
    monkeypatch.setattr(fixture, "PIECE_ROWS", 40)
    with fixture.order_pieces(spark, tmpdir_path) as pieces:
        held = [[tuple(r) for r in p.collect()] for p in pieces]
        assert len(held) == 5 and max(map(len, held)) <= 80
        assert sorted(sum(held, []), key=str) == sorted(rows, key=str)


def test_a_form_without_rows_is_an_error_of_the_table_only(spark, monkeypatch, tmpdir_path):
    """All keys of a piece may have one remainder; a table of such keys is refused, cut or not."""
    for name, keys in (("some", [0] * 40 + [1, 2]), ("none", [0, 3] * 40)):
        spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmpdir_path}/{name}/orders.parquet")
    monkeypatch.setattr(fixture, "PIECE_ROWS", 20)
    assert queries.ingest_mixed(spark, tmpdir_path + "/some").count() == 42
    with pytest.raises(ValueError, match="nothing to write"):
        queries.ingest_mixed(spark, tmpdir_path + "/none")
