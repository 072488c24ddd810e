"""One-hot encoding by a dictionary table (F2, T7), for more categories than a row of literals can hold.

The dictionary is a table: a category's code is its rank among the sorted categories (NULL last), found by range partitions that are sorted
and counted, so no task and no driver holds all categories. Rows take their code by a join. Categories that hold more than one row
in HOT are few by definition (fewer than HOT), so they are broadcast; the rows they match are dealt over all tasks in the join
with the others.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path

#: A category with more than one row in HOT of the fitted table is hot.
HOT = 200


def fit_dictionary(df: DataFrame, col: str, path: str | None = None, with_null: bool = True) -> DataFrame:
    """Write and return the dictionary of ``col``: category, code (0, 1, ... in order of the categories, NULL last), n (its rows).

    ``with_null=False`` gives NULL no code. Empty table: no categories."""
    spark = df.sparkSession
    path = path or work_path(spark, "dictionary")
    counted = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    if not with_null:
        counted = counted.where(F.col("category").isNotNull())
    order = F.col("category").asc_nulls_last()
    # the number of a row: its partition in the upper bits, its place there in the lower 33
    numbered = counted.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    sorted_path = work_path(spark, "dictionary-sorted")
    numbered.write.parquet(sorted_path)
    numbered = spark.read.schema(numbered.schema).parquet(sorted_path).withColumn("_part", F.shiftright("_at", 33))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    code = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered.join(base, F.col("_part") == F.col("_p")).select("category", code.alias("code"), "n").write.mode("overwrite").parquet(path)
    return load_dictionary(spark, path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary written by ``fit_dictionary``."""
    return spark.read.parquet(path)


def encode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "code") -> DataFrame:
    """``df`` with its category's code in ``out``; NULL for categories that the dictionary lacks. Every row stays, in whatever number."""
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    hot = dictionary.where(F.col("n") * HOT > total).select(F.col("category").alias("_hot"), F.col("code").alias("_hot_code"))  # fewer than HOT rows
    rest = dictionary.where(F.col("n") * HOT <= total).select(F.col("category").alias("_cat"), F.col("code").alias("_code"), F.lit(0).cast("long").alias("_zero"))
    d = df.join(F.broadcast(hot), F.col(col).eqNullSafe(F.col("_hot")), "left")
    # rows that have their code meet nothing below: a key of their own deals them over the tasks
    d = d.withColumn("_deal", F.when(F.col("_hot_code").isNotNull(), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)))
    d = d.join(rest, F.col(col).eqNullSafe(F.col("_cat")) & (F.col("_deal") == F.col("_zero")), "left")
    return d.select(*(df[f"`{c}`"] for c in df.columns), F.coalesce("_hot_code", "_code").alias(out))


def one_hot_sparse(df: DataFrame, col: str, dictionary: DataFrame, out: str = "one_hot", drop_last: bool = False) -> DataFrame:
    """``df`` with a sparse vector (size, indices, values) in ``out``. Unknown categories, and the last one under ``drop_last``, are all zeros."""
    n = dictionary.count()
    size = n - 1 if drop_last and n > 1 else n
    code = "_code_of_" + out
    there = F.col(code) < size
    vector = F.struct(F.lit(size).cast("long").alias("size"), F.when(there, F.array(code)).otherwise(F.array().cast("array<bigint>")).alias("indices"),
                      F.when(there, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    return encode(df, col, dictionary, code).withColumn(out, vector).drop(code)
