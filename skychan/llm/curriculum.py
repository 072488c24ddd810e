"""Operator 8: mixing sources to target weights by a time-varying curriculum.

Targets: the sources, by code point and null last, have weights 5, 2, 1, repeating, and share the
corpus's words; no target is above ``most`` times its source's words, what is above is shared out
again by weight (the level at which this comes to rest is found in closed form).

Curriculum: each weight has a schedule, weights at equal steps of the training time from 0 to 1 with
straight lines between. Its integral, scaled so that it ends at the source's target, is the
source's cumulative demand for words. A source's documents stand in a queue in a fixed pseudo-random
order, repeated up to ``most`` times. The middle word of each copy is demanded at one time, found
by inverting the cumulative demand (a quadratic within a step): the copy's training position.
Copies that are not demanded by time 1 are not taken. Then, in each source, the one copy whose
coming or going brings the words taken nearest to the target is added or left out.

``positions`` gives a row per copy, range-sorted by position, ``taken`` sums the words of that order per document, ``training_rows`` gives the
documents' rows, a row a copy, in that order.

Defined results. Null or empty text: size 0, nothing taken; such a row keeps its first copy if its
place in the queue is demanded. Null source: a source, last in order. Null doc_id, repeated rows:
documents like others. Empty table: no rows. All rows of a source without words: target 0.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychan.llm.common import SPACE, batches_of, fresh, rows_of, text_digest, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Schedule of each weight: heavy sources rise with time, light ones fall.
SCHEDULES = ((0.8, 1.0, 1.2), (1.0, 1.0, 1.0), (1.2, 1.0, 0.8))


def queues(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow table in queue order: part, row (its number there), source, doc_id, digest, size, start (words of the source before it in its part)."""

    def sized(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it):
            n = pc.count_substring_regex(texts, rf"[^{SPACE}]+").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("digest"), n], ["doc_id", "source", "digest", "size"])

    def summed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total, row = TaskContext.get().partitionId(), object(), 0, 0
        for batch in it:
            size, start = batch.column("size").to_numpy(zero_copy_only=False), np.empty(batch.num_rows, np.int64)
            for i, source in enumerate(batch.column("source").to_pylist()):
                if source != last:
                    last, total = source, 0
                start[i] = total
                total += int(size[i])
            rows = np.arange(row, row + len(start))
            row += len(start)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(start), pa.int32()), pa.array(rows), *(batch.column(c) for c in ("source", "doc_id", "digest", "size")), pa.array(start)],
                                             ["part", "row", "source", "doc_id", "digest", "size", "start"])

    narrow = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
              .mapInArrow(sized, "doc_id long, source string, digest string, size long"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keys = [F.col("source").asc_nulls_last(), F.col("order"), F.col("doc_id"), F.col("digest")]
    return written(narrow.withColumn("order", order).repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .select("source", "doc_id", "digest", "size")
                   .mapInArrow(summed, "part int, row long, source string, doc_id long, digest string, size long, start long"), "queues")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also kind (index of its weight), target. A row a source: the windows hold sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.withColumn("kind", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
         .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    # if the sources that fill up first are at their caps, the others' level is (all words - caps) / their weights; the true level is the highest of these
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    s = s.withColumn("level", level)
    return s.select("source", "source_size", "kind", F.least("cap", F.max("level").over(everything) * F.col("w")).alias("target"))


def demand_time(share: Column, schedule: Sequence[float]) -> Column:
    """When a schedule's integral reaches ``share`` of its whole: inverse of the cumulative demand. Null if it never does (from 1 on)."""
    steps = len(schedule) - 1
    areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, low = sum(areas), 0.0
    found = None
    for i, area in enumerate(areas):
        a, slope = schedule[i], (schedule[i + 1] - schedule[i]) * steps
        need = share * F.lit(whole) - F.lit(low)
        # a t + slope t^2 / 2 = need, in the form that is right for slope 0 too
        t = 2 * need / (F.lit(float(a)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(float(a) ** 2) + 2 * F.lit(float(slope)) * need)))
        at = F.lit(i / steps) + t
        low += area
        test = share * F.lit(whole) <= F.lit(low)
        found = F.when(test, at) if found is None else found.when(test, at)
    return F.when(share < 1, F.least(found.otherwise(F.lit(1.0)), F.lit(1.0)))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[float] = WEIGHTS, most: int = MOST, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """A row a document: part, row, doc_id, digest, source, size, source_size, target, times (training positions of the copies taken)."""
    table = queues(docs, id_col, text_col, source_col)
    parts = table.groupBy("source", "part").agg(F.sum("size").alias("n"))
    sources = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    bases = written(parts.join(sources.withColumnRenamed("source", "s"), parts["source"].eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "b_source", "part": "b_part"}), "bases")
    d = (table.join(bases, (table["part"] == bases["b_part"]) & table["source"].eqNullSafe(bases["b_source"]))
         .withColumn("at", F.col("base") + F.col("start")).drop("base", "start", "b_part", "b_source"))

    # the middle word of copy j is demanded when the source's cumulative demand reaches its place; beyond the whole demand it never is
    def time(j: int) -> Column:
        share = F.when(F.col("target") > 0, (F.col("at") + F.col("size") / 2 + F.lit(j) * F.col("source_size")) / F.col("target")).otherwise(F.lit(1.0))
        out = None
        for i, schedule in enumerate(schedules):
            one = demand_time(share, schedule)
            out = F.when(F.col("kind") == i, one) if out is None else out.when(F.col("kind") == i, one)
        return out

    times = F.filter(F.array(*map(time, range(most))), lambda t: t.isNotNull())
    d = written(d.withColumn("times", times).withColumn("whole", F.size("times")).drop("kind"), "placed")
    left = (d.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("whole")).alias("n"))
            .select(F.col("source").alias("l_source"), (F.col("t") - F.col("n")).alias("left")))
    left = written(left, "left-over")
    d = d.join(left, d["source"].eqNullSafe(left["l_source"])).drop("l_source")
    can = F.when(F.col("left") > 0, F.col("whole") < most).otherwise(F.col("whole") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("left"))
    best = (d.filter(can).groupBy(F.col("source").alias("x_source")).agg(F.min(F.struct(F.abs(F.col("size") - F.abs("left")).alias("off"), "at")).alias("b"))
            .select("x_source", F.col("b.at").alias("x_at"), F.lit(True).alias("turned")))
    best = written(best, "turned")
    d = d.join(best, d["source"].eqNullSafe(best["x_source"]) & (d["at"] == best["x_at"]) & (d["size"] > 0), "left")
    # the copy that is added comes last; of the one that is left out the latest goes
    times = F.when(F.col("turned") & (F.col("left") > 0), F.concat("times", F.array(F.lit(1.0)))).when(F.col("turned"), F.slice("times", F.lit(1), F.col("whole") - 1)).otherwise(F.col("times"))
    return d.withColumn("times", times).drop("x_source", "x_at", "turned", "left", "whole", "at")


def positions(docs: DataFrame, **options) -> DataFrame:
    """A row a copy taken, range-sorted by training position: part, row, doc_id, digest, source, size, copy, position (time of its middle word, 0 to 1)."""
    return of_copies(placed(docs, **options))


def of_copies(places: DataFrame) -> DataFrame:
    each = places.select("part", "row", "doc_id", "digest", "source", "size", F.posexplode("times").alias("copy", "position"))
    keys = ["position", "doc_id", "part", "row", "copy"]
    return each.repartitionByRange(*keys).sortWithinPartitions(*keys)


def taken(docs: DataFrame, **options) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken (words of all its copies in the training order), position (of its first
    copy there, null without one)."""
    places = written(placed(docs, **options), "places")
    order = written(of_copies(places).select("part", "row", "size", "position"), "training-order")
    sums = order.groupBy("part", "row").agg(F.sum("size").alias("taken"), F.min("position").alias("position"))
    return places.join(sums, ["part", "row"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows of ``docs``, a row a copy taken, range-sorted by training position."""
    where = positions(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # repeated rows are one identity with a row for each of their copies
    at = fresh(docs, "_position")[0]
    where = written(where.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("position").alias(at)), "positions")
    rows = rows_of(docs, where, id_col, text_col)
    return rows.repartitionByRange(at, id_col).sortWithinPartitions(at, id_col).drop(at)
