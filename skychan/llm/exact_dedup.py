"""Operator 9: exact duplicates by content-defined chunk recipes (DataFrame functions only).

A text (null: empty) is normalised: each run of space, tab, LF, VT, FF, CR becomes one space. It is
cut into chunks where its content says so, never by position alone, so that texts that share a
passage share chunks. Its recipe is the ordered list of the chunks' identifiers, 64-bit hashes.

The identifiers are verified: each distinct (hash, chunk text) is shuffled once, after a map-side
aggregation, and a hash that stands for two texts is a clash. A recipe that holds a clashing hash
also carries the SHA-256 of its text. After that only recipes move: texts are equal when their
recipes are. Long documents are never moved whole.

Defined results. Null and empty text: equal to each other. Null doc_id: a row like others; it stays
only if its group has no other ids. Repeated rows: each comes out, one of them is kept. Empty
table: no rows. Other columns of the input play no part.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import rows_of, text_digest, written

#: A chunk has at least MIN_CHARS characters and at most MAX_CHARS; it ends at the first BOUNDARY after the least.
MIN_CHARS, MAX_CHARS = 1024, 8192
BOUNDARY = r"[aehnot\x{3002}][\x20.,;:!?][^\x20]"


def normalised(text: Column) -> Column:
    """Only runs other than a single space are replaced: the result is the same, with fewer replacements."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunks(norm: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Content-defined chunks of a text, in order; together they are the whole text."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the raw text's _digest."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), text_digest(F.col(text_col)).alias("_digest"))
    recipes = written(norm.select(
        "doc_id", "_digest", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c)).alias("recipe")), "recipes")
    # each distinct chunk moves once; a hash of two chunks is a clash
    distinct = (norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
                .select(chunk_hash(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one")))
    clashes = written(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "clashes")
    if clashes.isEmpty():
        keyed = recipes.withColumn("proof", F.lit(""))
    else:
        unsure = (recipes.select("recipe", F.explode("recipe").alias("h")).join(clashes, "h", "left_semi")
                  .select("recipe").distinct().withColumn("unsure", F.lit(True)))
        keyed = (recipes.join(unsure, "recipe", "left")
                 .withColumn("proof", F.when(F.col("unsure"), F.col("text_sha256")).otherwise("")).drop("unsure"))
    keyed = keyed.withColumn("key", F.xxhash64("recipe", "proof"))
    groups = keyed.groupBy("key", "recipe", "proof").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # rows that repeat an id and a text are counted, then dealt out again
    rows = keyed.groupBy("doc_id", "_digest", "text_sha256", "key", "recipe", "proof").agg(F.count("*").alias("copies"))
    first = rows.groupBy("key", "recipe", "proof").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_digest")).alias("first"))
    groups = groups.join(first, ["key", "recipe", "proof"])
    return (rows.join(groups, ["key", "recipe", "proof"])
            .select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_digest") == F.col("first._digest")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256", "_digest"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), "_digest")
    return rows_of(docs, written(kept, "kept-exact"), id_col, text_col)
