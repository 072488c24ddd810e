"""Event-time statistics of a stream (E7, E8): tumbling and session windows with a watermark, late rows counted.

Three streams read the same source. Two hold state under a watermark (``delay`` behind the greatest event time seen) and append a window
once it is closed: one the statistics of tumbling windows, one sessions. The third keeps no state: per micro-batch it stores how many rows
came for each window, a batch replacing its own partition. A window's late rows are those that came less those that its closed state
counted. A window whose rows all came late has no state and no row of its own; ``received`` holds its count.

State holds a few numbers and a quantile sketch of bounded size a (group, window); rows are combined before they are shuffled, so a group
with a third of all rows costs no more than others. Sessions of one key meet in one task with the rows of one micro-batch, whose size
``max_files_per_trigger`` bounds. Windows that the watermark hasn't passed stay in the state for the next run of the same checkpoint.

Defined results. NULL event time: in no window, counted by ``untimed_rows``. NULL or NaN value: counted in ``n_rows`` only. NULL group: a
group like others. Empty source: no rows. A source that is replayed after a failure: each window once (checkpoint and sink are
committed together).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.joins import join_null_safe
from .mixed import replace_batch

#: Accuracy of the quantile sketches (relative error of a rank about 1.3 % at 200).
SKETCH_K = 200


def _statistics(value: str) -> list[Column]:
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return [F.count("*").alias("n_rows"), F.count(v).alias("count"), F.avg(v).alias("mean_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"),
            F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, F.lit(0.0)).alias("stddev_ms"), F.sum(v).alias("total_ms"),
            F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch")]


def _append(out: DataFrame, out_dir: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start(out_dir)


def start_tumbling(rows: DataFrame, time_col: str, value: str, group: Sequence[str], window: str, delay: str, out_dir: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Append the statistics of each closed window: the group, ``start``, ``end``, the measures of E7 and a quantile sketch."""
    agg = rows.withWatermark(time_col, delay).groupBy(*group, F.window(time_col, window).alias("_w")).agg(*_statistics(value))
    out = agg.select(*group, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in agg.columns if c not in (*group, "_w")])
    return _append(out, out_dir, checkpoint, available_now)


def start_sessions(rows: DataFrame, time_col: str, value: str, group: Sequence[str], gap: str, delay: str, out_dir: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Append each closed session: rows of a group that follow each other within less than ``gap``; ``end`` is the last row's time plus the gap."""
    v = F.col(value).cast("double")
    agg = rows.withWatermark(time_col, delay).groupBy(*group, F.session_window(time_col, gap).alias("_w")).agg(
        F.count("*").alias("n_rows"), F.sum(F.when(~F.isnan(v), v)).alias("total_ms"))
    out = agg.select(*group, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_rows", "total_ms")
    return _append(out, out_dir, checkpoint, available_now)


def start_received(rows: DataFrame, time_col: str, group: Sequence[str], window: str, out_dir: str, checkpoint: str, available_now: bool = True,
                   on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Per micro-batch and window, the rows that came; ``start`` is NULL for rows without a time."""

    def count(batch_rows: DataFrame, batch: int) -> None:
        timed = batch_rows.where(F.col(time_col).isNotNull()).groupBy(*group, F.window(time_col, window).alias("_w")).agg(F.count("*").alias("n"))
        untimed = batch_rows.where(F.col(time_col).isNull()).groupBy(*group).agg(F.count("*").alias("n"))
        both = timed.select(*group, F.col("_w.start").alias("start"), "n").unionByName(untimed.withColumn("start", F.lit(None).cast("timestamp")))
        replace_batch(both, out_dir, batch)
        if on_batch is not None:
            on_batch(batch)

    w = rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def closed_windows(closed: DataFrame, received: DataFrame, group: Sequence[str]) -> DataFrame:
    """The closed windows with ``n_late``, rows a second of event time, and median, p95 and p99 of the sketch (approximate)."""
    came = received.where(F.col("start").isNotNull()).groupBy(*group, "start").agg(F.sum("n").alias("_came"))
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    out = join_null_safe(closed, came, [*group, "start"]).withColumn("n_late", F.col("_came") - F.col("n_rows")).withColumn("rows_per_s", F.col("n_rows") / seconds)
    for name, q in (("median_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
        out = out.withColumn(name, F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))))
    return out.drop("_came", "sketch")


def untimed_rows(received: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows without an event time per group."""
    return received.where(F.col("start").isNull()).groupBy(*group).agg(F.sum("n").alias("untimed"))


def windowed_timings(spark: SparkSession, source: str, schema: T.StructType, time_col: str, value: str, group: Sequence[str], window: str, delay: str,
                     work: str, max_files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Process every Parquet file present now in ``source``; the closed windows and the stored counts of rows that came.

    ``work`` is a folder of the shared file system that belongs to this stream: called again, only new files are read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    queries = [start_tumbling(rows, time_col, value, group, window, delay, f"{work}/closed", f"{work}/closed-checkpoint"),
               start_received(rows, time_col, group, window, f"{work}/received", f"{work}/received-checkpoint")]
    for q in queries:
        q.awaitTermination()
    kinds = {f.name: f.dataType for f in schema}
    keys = ", ".join(f"`{g}` {kinds[g].simpleString()}" for g in group)
    closed = spark.read.schema(f"{keys}, start timestamp, end timestamp, n_rows long, count long, mean_ms double, min_ms double, max_ms double, "
                               "stddev_ms double, total_ms double, sketch binary").parquet(f"{work}/closed")
    received = spark.read.schema(f"{keys}, start timestamp, n long, batch int").parquet(f"{work}/received")
    return closed_windows(closed, received, group), received


def sessions(spark: SparkSession, source: str, schema: T.StructType, time_col: str, value: str, group: Sequence[str], gap: str, delay: str,
             work: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Process every Parquet file present now in ``source``; the closed sessions."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    start_sessions(rows, time_col, value, group, gap, delay, f"{work}/sessions", f"{work}/sessions-checkpoint").awaitTermination()
    kinds = {f.name: f.dataType for f in schema}
    keys = ", ".join(f"`{g}` {kinds[g].simpleString()}" for g in group)
    return spark.read.schema(f"{keys}, start timestamp, end timestamp, n_rows long, total_ms double").parquet(f"{work}/sessions")
