"""Reports over grouping sets with exact distinct counts.

``count(DISTINCT id)`` over several grouping sets expands every row once a set and shuffles (set, group, id) for each of them. Here rows are
read and combined once: per finest group, bitmaps of the identifiers in blocks of 32,768 numbers, with the sums of the other
measures. Bitmaps of a block merge by OR, sums add, so every subtotal is made of those partial results; only they are
expanded. A hot group is spread over its blocks, and identifiers never move.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_path


def grouping_sets(dims: Sequence[str], kind: str = "cube") -> list[tuple[str, ...]]:
    """All subsets (``cube``) or all beginnings (``rollup``) of the dimensions."""
    if kind == "cube":
        return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]
    if kind == "rollup":
        return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]
    raise ValueError("kind must be 'cube' or 'rollup'")


def distinct_rollup(df: DataFrame, dims: Sequence[str], distinct: str, sums: dict[str, Column] | None = None, sets: Sequence[Sequence[str]] | None = None,
                    kind: str = "cube") -> DataFrame:
    """One row per group of every grouping set: the dimensions (NULL where rolled up), ``level`` (bit i set: dimension i is rolled up,
    the first one highest, as SQL's GROUPING_ID), ``n`` rows, ``n_distinct`` different non-NULL integers of ``distinct``, and ``sums``.

    NULL is a group like others, told from subtotals by ``level``. An empty table has no groups, and 0 in the total."""
    dims, sums = list(dims), dict(sums or {})
    if "bigint" != df.schema[distinct].dataType.simpleString() and df.schema[distinct].dataType.simpleString() not in ("int", "smallint", "tinyint"):
        raise ValueError(f"`{distinct}` must hold integers; give others numbers first")
    sets = [tuple(s) for s in (sets if sets is not None else grouping_sets(dims, kind))]
    ident = F.col(distinct).cast("bigint")
    part = df.groupBy(*dims, F.bitmap_bucket_number(ident).alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(ident)).alias("_bits"), F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    path = work_path(df.sparkSession, "rollup")
    part.write.parquet(path)
    part = df.sparkSession.read.schema(part.schema).parquet(path)
    # one row a grouping set and partial result; the level keeps NULL groups apart from subtotals
    level = {s: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s) for s in sets}
    rolled = F.explode(F.array(*(F.struct(F.lit(level[s]).alias("level"), *(F.col(d).alias(d) if d in s else F.lit(None).cast(part.schema[d].dataType).alias(d) for d in dims)) for s in sets)))
    each = part.select(rolled.alias("_g"), "_block", "_bits", "n", *sums).select("_g.*", "_block", "_bits", "n", *sums)
    blocks = each.groupBy("level", *dims, "_block").agg(F.bitmap_or_agg("_bits").alias("_bits"), F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums))
    ones = F.when(F.col("_block").isNotNull(), F.bitmap_count("_bits"))
    out = blocks.groupBy("level", *dims).agg(F.sum("n").alias("n"), F.coalesce(F.sum(ones), F.lit(0)).alias("n_distinct"), *(F.sum(name).alias(name) for name in sums))
    if () in sets:  # the total is there for an empty table, too
        total = sum(1 << i for i in range(len(dims)))
        empty = df.sparkSession.createDataFrame([(total,)], "t int")
        out = empty.join(out.where(F.col("level") == total), F.col("t") == F.col("level"), "left").select(
            F.col("t").alias("level"), *dims, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), *sums
        ).unionByName(out.where(F.col("level") != total))
    return out
