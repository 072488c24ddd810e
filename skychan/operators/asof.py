"""As-of join: to each row of one table the last earlier row of the other with the same key.

A join of the two tables by key with a filter on time would pair all rows of a key. Here both are
united and range-sorted by (key, time), so that a hot key lies in as many partitions as its rows fill. In each piece
(the rows of a key in one partition) a running last value finds the match; what precedes a piece is its carry: the last
right row of the key's earlier pieces, from a table with one row a piece. So no task
sees more of a key than a partition holds, and the result depends on neither partitions nor hot keys.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, values: Sequence[str],
              strict: bool = True, prefix: str = "last_", partitions: int | None = None) -> DataFrame:
    """Rows of ``left`` with the ``values`` (and the time) of the last row of ``right`` with equal ``keys`` and an earlier ``time``.

    ``strict``: earlier means before, otherwise at the same time too. Of right rows of one time that with the largest
    ``tie`` counts (NULL lowest). NULL keys match NULL keys. Left rows with a NULL time, and those without an earlier row, get
    NULLs; right rows with a NULL time match nothing. Every left row comes out once, repeated ones as often."""
    spark = left.sparkSession
    taken = [f"{prefix}{c}" for c in (time, *values)]
    clash = sorted({c.lower() for c in taken} & {c.lower() for c in left.columns})
    if clash:
        raise ValueError(f"the result would have {clash} twice: choose another prefix")
    payload = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    found = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip((time, *values), taken)))
    key = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
    lefts = left.select(key.alias("key"), F.col(time).alias("time"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.lit(True).alias("is_left"),
                        payload.alias("row"))
    rights = right.where(F.col(time).isNotNull()).select(key.alias("key"), F.col(time).alias("time"), F.col(tie).alias("tie"), F.lit(False).alias("is_left"), found.alias("found"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    # at one time left rows come first if only earlier rows count
    turn = F.col("is_left").desc() if strict else F.col("is_left").asc()
    order = ["key", F.col("time").asc_nulls_first(), turn, F.col("tie").asc_nulls_first()]
    ranged = both.repartitionByRange(partitions, *order) if partitions else both.repartitionByRange(*order)
    path = work_path(spark, "asof")     # partitions are numbered once: a range sort that runs again may cut elsewhere
    ranged.withColumn("piece", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(ranged.withColumn("piece", F.lit(0)).schema).parquet(path)
    ends = (cut.where("NOT is_left").groupBy("key", "piece")
            .agg(F.max_by("found", F.struct("time", F.col("tie").isNotNull(), "tie")).alias("end")))
    pieces = cut.groupBy("key", "piece").agg(F.count("*").alias("_n")).drop("_n").withColumnsRenamed({"key": "k", "piece": "p"})
    pieces = pieces.join(ends, pieces["k"].eqNullSafe(ends["key"]) & (pieces["p"] == ends["piece"]), "left").select("k", "p", "end")
    # a row a piece: at most as many of a key as there are partitions
    earlier = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("k", "p", F.last("end", ignorenulls=True).over(earlier).alias("carry")).where("carry IS NOT NULL")
    inside = Window.partitionBy("piece", "key").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("found", ignorenulls=True).over(inside)).where("is_left")
    out = near.join(carry, near["key"].eqNullSafe(carry["k"]) & (near["piece"] == carry["p"]), "left")
    match = F.when(F.col("time").isNotNull(), F.coalesce("near", "carry"))
    return out.select("row", match.alias("match")).select("row.*", *(F.col(f"match.`{n}`").alias(n) for n in taken))
