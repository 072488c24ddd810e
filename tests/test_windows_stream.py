"""Event-time windows of a stream: late rows, restarts, a hot key, NULLs."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skychan.streaming.windows import sessions, start_received, untimed_rows, windowed_timings

ROWS = StructType().add("k", "string").add("at", "timestamp").add("v", "double").add("k_", "string")
T0 = dt.datetime(2024, 1, 1)


def put(spark, src, rows):
    spark.createDataFrame([(*r, "x") for r in rows], ROWS).coalesce(1).write.mode("append").parquet(src)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, src, work):
    return windowed_timings(spark, src, ROWS, "at", "v", ["k"], "10 minutes", "5 minutes", work, max_files_per_trigger=1)


def test_late_rows_are_counted_and_state_outlives_a_restart(spark, tmpdir_path):
    src, work = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "work")
    put(spark, src, [("a", at(1), 1.0), ("a", at(2), float("nan")), (None, at(3), 5.0), ("a", None, 9.0)])
    put(spark, src, [("a", at(12), 2.0)])
    first, _ = run(spark, src, work)
    assert first.count() == 0                      # the watermark stands at minute 7: nothing is closed
    put(spark, src, [("a", at(4), 3.0), ("a", at(40), 4.0)])   # out of order, but in time: state of the first run is there
    put(spark, src, [("a", at(41), None)])
    put(spark, src, [("a", at(5), 7.0), ("a", at(6), 7.0), ("a", at(13), 7.0)])  # too late
    out, received = run(spark, src, work)
    got = {(r.k, int((r.start - T0).total_seconds() // 60)): r for r in out.collect()}
    assert set(got) == {("a", 0), (None, 0), ("a", 10)}
    a = got["a", 0]
    assert (a.n_rows, a["count"], a.n_late, a.mean_ms, a.total_ms, a.min_ms, a.max_ms) == (3, 2, 2, 2.0, 4.0, 1.0, 3.0)
    assert (got["a", 10].n_rows, got["a", 10].n_late, got["a", 10].stddev_ms) == (1, 1, 0.0)
    assert (got[None, 0].n_rows, got[None, 0].n_late) == (1, 0)
    assert [tuple(r) for r in untimed_rows(received, ["k"]).collect()] == [("a", 1)]
    again, _ = run(spark, src, work)               # nothing new: nothing twice
    assert again.count() == 3


def test_a_failed_batch_of_the_counting_stream_counts_once(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    for i in range(3):
        put(spark, src, [("a", at(i), 1.0)] * 4)

    def fail(batch):
        if batch == 1:
            raise RuntimeError("executor gone")

    def start(on_batch=None):
        rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
        start_received(rows, "at", ["k"], "10 minutes", out, ck, on_batch=on_batch).awaitTermination()

    with pytest.raises(Exception, match="executor gone"):
        start(fail)
    start()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 12


def test_hot_key_and_sketch(spark, tmpdir_path):
    src, work = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "work")
    r = random.Random(3)
    values = [r.random() for _ in range(6000)]
    put(spark, src, [("hot" if i % 3 else f"k{i % 50}", at(r.random() * 10), v) for i, v in enumerate(values)])
    put(spark, src, [("end", at(60), 0.0)])
    put(spark, src, [("end", at(61), 0.0)])
    out, _ = run(spark, src, work)
    got = {r.k: r for r in out.collect()}
    hot = sorted(v for i, v in enumerate(values) if i % 3)
    assert got["hot"].n_rows == len(hot) and sum(r.n_rows for r in got.values()) == 6000
    for name, q in (("median_ms", .5), ("p95_ms", .95), ("p99_ms", .99)):
        rank = sum(v <= got["hot"][name] for v in hot) / len(hot)
        assert abs(rank - q) < 0.03


def test_sessions_match_brute_force(spark, tmpdir_path):
    src, work = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "work")
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "b", None]), at(round(r.random() * 600, 3)), 1.0) for _ in range(300)]
    rows.sort(key=lambda x: x[1])
    files = [rows[:100], rows[100:200], rows[200:]]
    files[0], files[1] = files[0][:-9] + files[1][:9], files[1][9:] + files[0][-9:]  # out of order within the delay
    for f in files:
        put(spark, src, f)
    put(spark, src, [("end", at(5000), 0.0)])
    got = sorted((x.k or "", x.start, x.n_rows) for x in
                 sessions(spark, src, ROWS, "at", "v", ["k"], "5 minutes", "1 day", work, max_files_per_trigger=1).collect())
    want, open_ = [], {}
    for k, t, _ in rows:
        s = open_.get(k)
        if s and t - s[1] < dt.timedelta(minutes=5):
            s[1], s[2] = t, s[2] + 1
        else:
            if s:
                want.append((k or "", s[0], s[2]))
            open_[k] = [t, t, 1]
    want += [(k or "", s[0], s[2]) for k, s in open_.items()]
    assert got == sorted(want)
