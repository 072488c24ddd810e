"""Keyed access to id shards: the directory against brute force, with repeated ids over several partitions."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skychan.llm import common
from skychan.llm.mph_index import PerfectHash, build_index, lookup, write_directory, write_shards
from skychan.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, n long, part int, first long"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    common.ship(spark)
    rows = [(7 if i % 3 == 0 else None if i % 50 == 1 else i, None if i == 4 else f"text number {i} of a table", 1, 2, 3) for i in range(1500)]
    rows[10] = (10, "a long text " * 20_000, 1, 2, 3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    top = tmp_path_factory.mktemp("ids")
    path, directory = str(top / "shards"), str(top / "directory")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a doc_id lies in several parts
    try:
        write_shards(docs, path, shard_docs=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    write_directory(spark, path, directory, 64)
    return docs, rows, path, directory


def test_all_keys_are_distinct_and_give_their_text(spark, files):
    docs, rows, path, directory = files
    assert spark.read.parquet(path).select("part").distinct().count() > 1
    got = lookup(spark, path, directory, docs.groupBy("doc_id").agg(F.count("*").alias("n")), 64).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.nth) for r in got}) == len(rows)
    assert len({(r.part, r.shard, r.inside) for r in got}) == len(rows)  # no place twice
    t = Tokenizer.from_file(vocabulary_path())
    want = sorted((str(d), np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, x, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    hot = sorted(r.nth for r in got if r.doc_id == 7)
    assert hot == list(range(len(hot)))
    order = sorted((r.part, r.shard, r.inside, r.nth) for r in got if r.doc_id == 7)
    assert [x[3] for x in order] == hot  # numbered in the order of the files


def test_some_keys_and_keys_that_are_not_there(spark, files):
    _, rows, path, directory = files
    ids = [r[0] for r in rows]
    asked = [(7, 3), (10, 1), (10, 5), (None, 2), (-1, 4), (999_999, 1), (11, 0)]
    got = lookup(spark, path, directory, spark.createDataFrame(asked, "doc_id long, n int"), 64).collect()
    assert sorted((str(r.doc_id), r.nth) for r in got) == sorted([("7", 0), ("7", 1), ("7", 2), ("10", 0), ("None", 0), ("None", 1)])
    absent = spark.range(10_000_000, 10_020_000).select(F.col("id").alias("doc_id"))  # more than there are documents
    assert lookup(spark, path, directory, absent, 64).count() == 0
    one = lookup(spark, path, directory, spark.createDataFrame([(2,), (2,)], "doc_id long"), 64).collect()
    assert [(r.doc_id, r.nth) for r in one] == [(2, 0)] and ids.count(2) == 1


def test_values_of_a_perfect_hash():
    keys = [b"k%d" % i for i in range(1000)]
    values = np.arange(3000).reshape(1000, 3)
    index = PerfectHash(build_index(keys, values), 3)
    there, found = index.find(keys)
    assert there.all() and (found == values).all()
    assert not index.find([b"x%d" % i for i in range(1000)])[0].any()
