"""Helpers shared by the operators of this package.

Every operator first projects the columns it needs to its own names, so extra columns of the
caller, whatever they are called, can't clash with working columns.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skychan.session import SHUFFLE_CLEANUP, ship, work_path

#: Characters between words, as in the contracts of the queries.
SPACE = r"\x20\x09-\x0D"
#: Texts are handled in slices of about this many bytes, so that the memory of a task is bounded.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared work folder: cuts the lineage, survives a lost executor. ``tidy``: its shuffle files go once it is there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    if tidy:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(SHUFFLE_CLEANUP) if held is None else spark.conf.set(SHUFFLE_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_digest(text: Column) -> Column:
    """Digest of a raw text; null stays apart from empty."""
    return F.coalesce(F.md5(text), F.lit("null"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in whatever case."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
    return out


def rows_of(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` names by (``_id``, ``_digest``), with its other columns added.

    ``decisions`` may name a row several times (copies come out several times). Rows of ``docs``
    that repeat one (id, text) count as one row here, of which the one with the least hash of all its columns stays: only those are
    made distinct first, and only if there are any, so a table without repeated rows is shuffled once.
    """
    digest, whole = fresh(docs, "_row_digest", "_row_whole")
    columns = docs.columns
    d = docs.withColumn(digest, text_digest(F.col(text_col)))
    keys = docs.select(F.col(id_col).alias("_i"), text_digest(F.col(text_col)).alias("_g"))
    again = keys.groupBy("_i", "_g").count().filter("count > 1").select("_i", "_g")
    if not again.isEmpty():
        cond = d[id_col].eqNullSafe(again["_i"]) & (d[digest] == again["_g"])
        other = [F.col(f"`{c}`") for c in columns if c != text_col]
        one = (d.join(again, cond, "left_semi").groupBy(F.col(id_col).alias("_i"), F.col(digest).alias("_g"))
               .agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in d.columns)), F.xxhash64(F.to_json(F.struct(*other)))).alias(whole)).select(f"{whole}.*"))
        d = d.join(again, cond, "left_anti").unionByName(one)
    e = decisions.withColumnsRenamed({"_id": "_e_id", "_digest": "_e_digest"})
    return (d.join(e, d[id_col].eqNullSafe(e["_e_id"]) & (d[digest] == e["_e_digest"]))
            .select(*(d[f"`{c}`"] for c in columns), *(e[c] for c in e.columns if c not in ("_e_id", "_e_digest"))))


def plain_texts(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Texts with null as empty, offsets of 64 bits."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is alone in its range."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    a, total = 0, 0
    for i, n in enumerate(size):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(size):
        yield a, len(size)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between white space of all texts in a row, and where the words of each text begin (one more than texts).

    The library's splitter takes exactly space, tab, LF, VT, FF and CR; empty strings at the ends of a text go.
    """
    texts = pc.ascii_lower(texts) if lower else texts
    parts = pc.ascii_split_whitespace(pc.ascii_trim(texts, characters=" \t\n\v\f\r"))
    flat = parts.flatten()
    off = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    off = off - off[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        gone = np.concatenate([[0], np.cumsum(empty)])
        flat, off = flat.filter(pa.array(~empty)), off - gone[off]
    return flat, off


def batches_of(it: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts."""
    for b in it:
        texts = plain_texts(b.column(b.schema.get_field_index(text)))
        for i, j in slices(texts, limit):
            yield b.slice(i, j - i), texts.slice(i, j - i)


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
