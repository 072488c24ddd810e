"""Work of a task stays the same as the tables grow: rows dealt by number, files by task, nothing held in memory or stored plain."""
import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.plans import fixture, queries
from skychan.session import checkpoint_root
from skychan.streaming.mixed import ingest_mixed
from tests.conftest import SF_SMALL


def made(spark, prefix):
    """Folders below the work folder whose names begin with ``prefix``."""
    root = f"{checkpoint_root(spark)}/skychan-work"
    return {f"{root}/{d}" for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith(prefix)}


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]


def run(spark, query, prefix):
    before = made(spark, prefix)
    out = queries.QUERIES[query](spark, SF_SMALL)
    (path,) = made(spark, prefix) - before
    return out, files(path)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    n = fixture.read_table(spark, SF_SMALL, "orders").count()
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", n // 60)
    sizes = fixture.observations(spark, SF_SMALL).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 60 and max(r[1] for r in sizes) <= 2 * (n // 60) and sum(r[1] for r in sizes) == n


@pytest.mark.parametrize("query, prefix", [("ingest_stream", "stream-src"), ("ingest_mixed", "mixed-src")])
def test_files_of_a_stream_grow_with_the_rows(spark, monkeypatch, query, prefix):
    n = fixture.read_table(spark, SF_SMALL, "orders").count()
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", n // 20)
    out, written = run(spark, query, prefix)
    assert len(written) >= 20 and out.count() == n


def test_load_union_stores_its_texts_compressed(spark):
    out, written = run(spark, "load_union", "parts")
    assert written and all(f.endswith(".csv.gz") for f in written)
    assert out.agg(F.sum("n")).first()[0] == 2 * fixture.read_table(spark, SF_SMALL, "orders").count()


def test_a_batch_of_the_mixed_stream_is_not_held_in_memory(spark, monkeypatch, tmpdir_path):
    def held(*_):
        raise AssertionError("the rows of a batch are held by the executors")
    obs = queries.corrupted_cells(spark, SF_SMALL).limit(200)
    obs.write.option("header", True).option("escape", '"').csv(tmpdir_path + "/in")
    monkeypatch.setattr(DataFrame, "persist", held)
    monkeypatch.setattr(DataFrame, "cache", held)
    before = made(spark, "batch-")
    good, bad = ingest_mixed(spark, tmpdir_path + "/in", *(tmpdir_path + x for x in ("/o", "/r", "/c")))
    assert good.count() == 200 and bad.count() > 0
    assert made(spark, "batch-") == before       # the stored rows of a batch go with it


def test_batches_of_an_epoch_are_cut_into_files(spark, monkeypatch):
    from skychan.operators import model
    from skychan.operators.sampling import split_frames
    monkeypatch.setattr(model, "PIECE_ROWS", 100)
    train, val = split_frames(fixture.observations(spark, SF_SMALL), val_ratio=0.2, seed=42)
    before = made(spark, "epochs-")
    m = model.LinkStateModel().fit_epochs(train, val, epochs=1, batch_size=10_000, steps=1)
    (path,) = (p for p in made(spark, "epochs-") - before if not p.split("/")[-1].startswith(("epochs-train", "epochs-val")))
    sizes = [r[0] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*")).collect()]
    assert len(sizes) >= m.n_train // 300
