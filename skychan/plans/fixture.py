"""Deterministic observation view over the driver's test tables.

One observation per order (``obs_id = o_orderkey``) with a Tx->Rx vector, a
receiver type, a link state (10 % label noise), a rule-based "prediction",
and 20 paths of loss / four angles / delay, all derived from the key with
integer arithmetic, so another engine can rebuild them exactly. The work grows
with ``orders``. Arrays are built a batch of rows at a time with numpy: no
explode; only the two columns they are made from are dealt out over tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import norm3
from ..functions.paths import doubles, floats, lists, on_batches
from ..schema import LIGHT_SPEED
from ..session import drop_path, tidy, work_path

N_PATHS = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that one task of the per-row work takes: a task's time stays the same however large the table is.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, min_partitions: int | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Spread rows over the cluster when the scan yields fewer input splits
    than there are cores (a file with a single row group is one task), so the
    heavy per-row work that follows runs in parallel. With ``rows_per_task``
    the number of tasks grows with the rows too: splits are cut by bytes, so
    one split of a narrow table holds millions of rows. Inputs that already
    have enough splits are returned unchanged: no shuffle."""
    target = min_partitions
    try:
        target = target or df.sparkSession.sparkContext.defaultParallelism
        if rows_per_task:
            target = max(target, -(-df.count() // rows_per_task))   # read from the files' footers
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # no RDD access (e.g. a Connect session): leave the plan as is
        return df
    return df.repartition(target)


def _div100(c: Column) -> Column:
    return c / F.lit(100.0)


def path_values(key: np.ndarray, k: np.ndarray, d3d: np.ndarray) -> dict:
    """The six per-path quantities for observations ``key`` (a column) and slots ``k`` (a row)."""
    return {
        "pl": lambda: 140.0 + np.fmod(key * 31 + k * 17, 4001) / 100.0,
        "aoa_phi": lambda: -180.0 + np.fmod(key * 13 + k * 29, 36001) / 100.0,
        "aoa_theta": lambda: np.fmod(key * 11 + k * 37, 18001) / 100.0,
        "aod_phi": lambda: -180.0 + np.fmod(key * 17 + k * 41, 36001) / 100.0,
        "aod_theta": lambda: np.fmod(key * 23 + k * 43, 18001) / 100.0,
        "dly": lambda: d3d / LIGHT_SPEED + (np.fmod(key * 19 + k * 23, 801) - 100) * 1e-9,
    }


def path_arrays(kind: str, *names: str):
    """Function of key and distance: the named quantities of all slots, an array of four a slot if there are four."""
    @on_batches(kind)
    def run(key: pa.Array, d3d: pa.Array) -> pa.Array:
        there = np.repeat(key.is_valid().to_numpy(zero_copy_only=False), N_PATHS * len(names))
        keys = key.fill_null(0).to_numpy(zero_copy_only=False)[:, None]
        v = path_values(keys, np.arange(N_PATHS)[None, :], floats(d3d)[0][:, None])
        inner = doubles(np.stack([v[n]() for n in names], axis=-1), there)
        if len(names) > 1:
            inner = lists(np.full(len(key) * N_PATHS, len(names)), inner)
        return lists(np.full(len(key), N_PATHS), inner)
    return run


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What observations are made from."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical observation table (``obs_id`` + the nine declared columns) plus
    ``pred_state``, a fixed rule-based prediction for the metric operators."""
    return observed(order_keys(spark, sf_dir))


#: Observations that queries hold as text at a time. Their text is about 30 times the table they are made from.
PIECE_ROWS = 2_000_000


@contextmanager
def order_pieces(spark: SparkSession, sf_dir: str) -> Iterator[list[DataFrame]]:
    """``order_keys`` cut into tables of about ``PIECE_ROWS`` rows, each row in one of them, for queries that write observations
    as text: with a piece at a time, the text on disk stays the same however large the table is. Rows are dealt in runs by their
    place in the scan, so that repeated keys don't fill a piece; the two columns are stored once, so a piece reads its own rows only."""
    keys = order_keys(spark, sf_dir)
    n = -(-keys.count() // PIECE_ROWS)
    with tidy(spark):
        if n <= 1:
            yield [keys]
            return
        path = work_path(spark, "order-pieces")
        run = min(ROWS_PER_TASK, PIECE_ROWS)
        nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # place in the task
        piece = F.pmod(F.spark_partition_id() + F.floor(nth / run), F.lit(n)).cast("int")
        spread(keys, rows_per_task=ROWS_PER_TASK).withColumn("piece", piece).write.partitionBy("piece").parquet(path)
        try:
            stored = spark.read.parquet(path)
            there = sorted(r[0] for r in stored.select("piece").distinct().collect())
            yield [stored.filter(F.col("piece") == i).drop("piece") for i in there]
        finally:
            drop_path(spark, path)


def observed(orders: DataFrame) -> DataFrame:
    """The observations of some rows of ``order_keys``."""
    key = F.col("obs_id")
    base = (
        spread(orders, rows_per_task=ROWS_PER_TASK)
        .select(
            "obs_id",
            (F.col("o_custkey") % 2).cast("int").alias("rx_type"),
            (_div100(key * 7919 % 200003) - 1000).alias("x"),
            (_div100(key * 104729 % 200003) - 1000).alias("y"),
            (_div100(key * 1299709 % 30001) - 100).alias("z"),
        )
        .withColumn("d3d", norm3(F.col("x"), F.col("y"), F.col("z")))
    )
    d3d = F.col("d3d")
    link_state = (
        F.when(key % 10 == 0, (key % 3).cast("int"))
        .when(d3d < 600, F.lit(2)).when(d3d < 1100, F.lit(1)).otherwise(F.lit(0))
    )
    pred_state = F.when(d3d < 650, F.lit(2)).when(d3d < 1050, F.lit(1)).otherwise(F.lit(0))
    return base.select(
        "obs_id",
        F.array("x", "y", "z").alias("dvec"),
        "rx_type",
        link_state.cast("int").alias("link_state"),
        (F.lit(80.0) + _div100(key * 53 % 12001)).alias("los_pl"),
        F.array(*[F.lit(0.0)] * 4).alias("los_ang"),
        (d3d / F.lit(LIGHT_SPEED)).alias("los_dly"),
        path_arrays("array<double>", "pl")(key, d3d).alias("nlos_pl"),
        path_arrays("array<array<double>>", "aoa_phi", "aoa_theta", "aod_phi", "aod_theta")(key, d3d).alias("nlos_ang"),
        path_arrays("array<double>", "dly")(key, d3d).alias("nlos_dly"),
        pred_state.cast("int").alias("pred_state"),
    )
