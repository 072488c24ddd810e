"""Operator 3: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents in a fixed pseudo-random order. Time runs in windows of
``window`` sequences. In each window a source earns its share of the window's tokens (its share of
all tokens, so that all queues run dry together) and sends exactly what it has earned; what it
could not send, a fraction of a token, stays as its deficit and counts in the next window. As
documents may be cut, the deficits have a closed form: after k windows source s has sent
floor(k * window * T_s / T) tokens. So each task knows the state of the round-robin at any
window without the windows before, and no deficit is lost between windows or partitions.

The windows' tokens, source after source, form one stream; each ``seq_len`` tokens of it are a
sequence. Only the last sequence can be short.

Plan: one shuffle of the texts (range partitions by source and order), a table of token ids in the
shared folder, totals a partition and source (narrow), then one pass over the table that cuts.

Defined results. Null or empty text: the end id alone. Null source: a queue like others, last in
order. Null doc_id and repeated rows: pieces like others'. Empty table: no rows. More than
MAX_QUEUES sources: the smallest share one queue, so that the state a task holds is bounded; all
their documents are packed.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skychan.llm.common import batches_of, written
from skychan.llm.tokens import WordEncoder, vocabulary_path

SEQ_LEN, END_ID = 2048, 1
#: Sequences in a window.
WINDOW = 64
MAX_QUEUES = 4096
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Documents in queue order: part, source, doc_id, n, ids (unsigned 16 or 32 bits), start (tokens of the source before it in its part)."""

    def encode(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, last, sent = WordEncoder.of(vocabulary), TaskContext.get().partitionId(), object(), 0
        for batch, texts in batches_of(it, limit=6_000_000):
            flat, off = encoder.encode(texts)
            wide = len(flat) > 0 and int(flat.max()) > 0xFFFF
            kind = np.uint32 if wide or end_id > 0xFFFF else np.uint16
            ids, size, start = [], [], []
            for i, source in enumerate(batch.column("source").to_pylist()):
                if source != last:
                    last, sent = source, 0
                own = np.append(flat[off[i]:off[i + 1]], np.uint32(end_id)).astype(kind)
                ids.append(own.tobytes())
                size.append(len(own))
                start.append(sent)
                sent += len(own)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), batch.column("source"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(start, pa.int64()),
                 pa.array([kind().itemsize] * n, pa.int32()), pa.array(ids, pa.binary())],
                ["part", "source", "doc_id", "n", "start", "width", "ids"])

    queue = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
             .withColumn("order", F.xxhash64("doc_id", F.xxhash64("text"))))
    keys = [F.col("source").asc_nulls_last(), F.col("order"), F.col("doc_id")]
    return written(queue.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .select("doc_id", "source", "text")
                   .mapInArrow(encode, "part int, source string, doc_id long, n long, start long, width int, ids binary"), "queues")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None,
           end_id: int = END_ID, seq_len: int = SEQ_LEN, window: int = WINDOW, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece; see PIECES. ``window`` is the piece's window."""
    table = tokenised(docs, vocabulary or vocabulary_path(), end_id, id_col, text_col, source_col)
    spark = docs.sparkSession
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    # the largest sources have a queue each; max_queues rows at most reach the driver
    own = totals.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(max_queues - 1).collect()
    own = sorted(own, key=lambda r: (r.source is None, r.source or ""))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    tokens = [r.n for r in own] + [everything - sum(r.n for r in own)]
    names = [(r.source, i) for i, r in enumerate(own)]
    queue_of = F.broadcast(spark.createDataFrame(names, "q_source string, queue int")) if names else None  # max_queues rows at most
    if queue_of is not None:
        parts = parts.join(queue_of, parts["source"].eqNullSafe(queue_of["q_source"]), "left").drop("q_source")
    else:
        parts = parts.withColumn("queue", F.lit(0))
    parts = parts.withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    before = Window.partitionBy("queue").orderBy(F.col("source").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = (table.join(bases, (table["part"] == bases["b_part"]) & table["source"].eqNullSafe(bases["b_source"]))
              .select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "width", "ids"))
    per_window = seq_len * window

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list[int], list[int]]] = {}

        def state(k: int) -> tuple[list[int], list[int]]:
            """What each queue has sent before window k, and where in the stream each begins in window k."""
            if k not in known:
                if len(known) > 4096:
                    known.clear()
                sent = [min(k * per_window, everything) * t // everything for t in tokens]
                then = [min((k + 1) * per_window, everything) * t // everything for t in tokens]
                at, begins = sum(sent), []
                for a, b in zip(sent, then, strict=True):
                    begins.append(at)
                    at += b - a
                known[k] = sent, begins
            return known[k]

        names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
        for batch in it:
            out: list[list] = [[] for _ in names]
            cols = [batch.column(c) for c in ("doc_id", "source", "queue", "at", "n", "width", "ids")]
            for doc_id, source, q, at, n, width, ids in zip(*(c.to_pylist() if j < 6 else c for j, c in enumerate(cols)), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4")
                done = 0
                k = at * everything // (tokens[q] * per_window)
                while state(k)[0][q] > at:  # rounding: the window in which token `at` is sent
                    k -= 1
                while state(k + 1)[0][q] <= at:
                    k += 1
                while done < n:
                    while state(k + 1)[0][q] <= at + done:
                        k += 1
                    sent, begins = state(k)
                    place = begins[q] + at + done - sent[q]
                    length = min(n - done, state(k + 1)[0][q] - at - done, seq_len - place % seq_len)
                    for col, v in zip(out, (doc_id, source, done, length, zlib.crc32(ids[done:done + length]), n, place // seq_len, place % seq_len, k), strict=True):
                        col.append(v)
                    done += length
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return placed.mapInArrow(cut, PIECES)
