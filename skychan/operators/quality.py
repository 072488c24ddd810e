"""Validation and profiling (T9-T11), each one aggregate over the table."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REQUIRED_COLUMNS, SPEC


def _size(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def wrong_size(name: str, c: Column) -> Column:
    """True when a decoded array does not have its declared shape (row-level
    twin of the reference's equal-length check)."""
    dims = SPEC[name][1]
    if not dims:
        return F.lit(False)
    bad = F.size(c) != dims[0]
    if len(dims) == 2:
        bad = bad | F.exists(c, lambda a: a.isNull() | (F.size(a) != dims[1]))
    return c.isNotNull() & bad


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n, n_null, min_dim, max_dim) per column."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.sum(c.isNull().cast("bigint")).alias(f"nn{i}")]
        if isinstance(f.dataType, T.ArrayType):
            aggs += [F.min(_size(c)).alias(f"lo{i}"), F.max(_size(c)).alias(f"hi{i}")]
        else:
            aggs += [F.lit(None).cast("int").alias(f"lo{i}"), F.lit(None).cast("int").alias(f"hi{i}")]
        rows.append((f.name, f.dataType.simpleString(), i))
    s = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    from .metrics import _rows_from
    return _rows_from(s, [{"column": F.lit(n), "dtype": F.lit(t), "n": F.col("n"),
                           "n_null": F.coalesce(F.col(f"nn{i}"), F.lit(0)).cast("bigint"),
                           "min_dim": F.col(f"lo{i}").cast("bigint"), "max_dim": F.col(f"hi{i}").cast("bigint")}
                          for n, t, i in rows])


def validate(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One-row report (T9): rows, missing required columns, NULL cells, arrays
    of the wrong shape, out-of-range codes, and ``is_valid`` (non-empty, all
    required columns, every array of its declared shape)."""
    required = list(required)
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in present), F.lit(0).cast("bigint"))
    wrong = sum((wrong_size(c, F.col(c)).cast("bigint") for c in present if c in SPEC), F.lit(0).cast("bigint"))
    bad = F.lit(0).cast("bigint")
    if "link_state" in present:
        bad = bad + (F.col("link_state").isNotNull() & ~F.col("link_state").isin(0, 1, 2)).cast("bigint")
    if "rx_type" in present:
        bad = bad + (F.col("rx_type").isNotNull() & ~F.col("rx_type").isin(0, 1)).cast("bigint")
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("n_null_cells"),
               F.sum(wrong).alias("n_wrong_size"), F.sum(bad).alias("n_bad_code"))
    s = s.select("n_rows", F.lit(",".join(missing)).alias("missing_columns"),
                 *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_null_cells", "n_wrong_size", "n_bad_code")])
    return s.withColumn("is_valid", (F.col("n_rows") > 0) & F.lit(not missing) & (F.col("n_wrong_size") == 0))


def check_aligned(a: DataFrame, b: DataFrame, key: str = "obs_id", raise_on_mismatch: bool = True) -> DataFrame:
    """Row agreement of two derived frames (T11): rows per key are counted on each side first, then the
    unique keys are joined null-safely and the counts compared. ``only_a`` / ``only_b``: rows that one side
    has more; ``n``: rows of the larger side per key, summed. Raises when the sides differ."""
    ca = a.groupBy(F.col(key).alias("_ka")).agg(F.count(F.lit(1)).alias("_a"))
    cb = b.groupBy(F.col(key).alias("_kb")).agg(F.count(F.lit(1)).alias("_b"))
    j = ca.join(cb, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer").select(
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("_a", "_b")])
    zero = F.lit(0).cast("bigint")
    r = j.agg(*[F.coalesce(F.sum(v), zero).alias(n) for n, v in (
        ("only_b", F.greatest(F.col("_b") - F.col("_a"), zero)), ("only_a", F.greatest(F.col("_a") - F.col("_b"), zero)),
        ("n", F.greatest("_a", "_b")))])
    if raise_on_mismatch:
        row = r.first()
        if row["only_a"] or row["only_b"]:
            raise ValueError(f"rows of the two frames do not pair up: {row['only_a']} and {row['only_b']} without a partner")
    return r
