"""Operator 11: spelling variants of one edit, found by asymmetric q-chunks.

Words are near if exactly one inserted, deleted or replaced code point parts them. One word of a pair, u (the
shorter one), contributes two disjoint chunks, its halves; one edit lies in one half at most, so it preserves
the other. The other word, v, contributes its positional grams of the halves' lengths for each length that u can
have. A chunk is joined with equal grams within shift one: the first half lies at the start of both, the second
at the end, so its shift is the difference of lengths, 0 or 1. Grams further away can meet no chunk
and aren't written. What meets is verified by its edit distance.

A chunk that many words share (a third of all words may begin alike) would give all pairs of its words. Where chunk
rows times gram rows exceed ``bucket``, the half with the edit is halved again: one edit
preserves one of its two quarters, which lengthens what both words must share. This goes on, in buckets
that are still too large, until the edit is confined to one code point of u or the gap beside it; words that meet there are near, so
no pairs are made that aren't links, and none is lost at any bucket size. Chunks that hold more than 1 / ``heavy`` of the rows
(so fewer than ``heavy`` chunks) are told apart before rows are shuffled by chunk.

Forms: of a word's near words the one with the largest count (ties: smallest by code points), if its count is
``ratio`` times the word's own at least. Counts grow at least so along forms, so they end; a word's root is found by following them
in doubling steps.

Defined results. Null or empty text: no words. Null doc_id: hashed as an empty string. Repeated rows: their words
count again. Very long words: words like others, moved whole. Empty table: no rows. Other columns play no part.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import written

LEAST_CHARS, LEAST_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
#: Chunk rows times gram rows of a bucket that are compared directly; the links don't depend on it.
BUCKET = 1024
#: A chunk with more than one in so many rows goes a way of its own; the links don't depend on it.
HEAVY = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n. Runs shorter than ``least_chars`` can't become words, so they aren't taken out of the text."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % damage == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def bucket_key() -> Column:
    """What u and v share if the edit lies in ``start`` to ``end`` of u, a word of ``size`` code points; v has ``longer`` more there."""
    after = F.col("end") + F.col("longer")
    return F.struct("size", "start", "end", F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("start"))).alias("before"),
                    F.xxhash64(F.substring(F.col("word"), after + 1, F.length("word")), F.lit("after")).alias("behind"))


def halves(rows: DataFrame) -> DataFrame:
    """Rows with the edit confined to either half of ``start`` to ``end``; at one code point, to the gaps beside it."""
    middle = (F.col("start") + F.col("end")) / 2
    m = F.floor(middle).cast("int")
    one = F.col("end") - F.col("start") == 1
    spans = F.when(one, F.array(F.struct(F.col("start").alias("s"), F.col("start").alias("e")), F.struct(F.col("end").alias("s"), F.col("end").alias("e")))) \
        .otherwise(F.array(F.struct(F.col("start").alias("s"), m.alias("e")), F.struct(m.alias("s"), F.col("end").alias("e"))))
    cut = rows.withColumn("span", F.explode(spans)).withColumn("start", F.col("span.s")).withColumn("end", F.col("span.e"))
    return cut.withColumn("key", bucket_key()).select("key", "gram", "longer", "word", "n", "size", "start", "end")


def near_pairs(words: DataFrame, bucket: int = BUCKET, heavy: int = HEAVY) -> DataFrame:
    """u, nu, v, nv of all pairs of different words that are one edit apart; a pair may come out twice."""
    as_u = F.struct(F.lit(False).alias("gram"), F.lit(0).alias("longer"))
    as_v = [F.struct(F.lit(True).alias("gram"), F.lit(k).alias("longer")) for k in (0, 1)]
    all_ = words.select("word", "n", F.explode(F.array(as_u, *as_v)).alias("as")).select("word", "n", "as.gram", "as.longer")
    work = halves(all_.withColumn("size", F.length("word") - F.col("longer")).withColumn("start", F.lit(0)).withColumn("end", F.col("size")))
    found, turn = [], 0
    while True:
        turn += 1
        # rows that meet something, and how many pairs that would be
        counts = (work.groupBy("key").agg(F.count_if(~F.col("gram")).alias("u"), F.count_if("gram").alias("v")).filter("u > 0 AND v > 0"))
        counts = written(counts.select("key", (F.col("u") + F.col("v")).alias("rows"), (F.col("u") * F.col("v")).alias("pairs")), f"chunks-{turn}")
        can_cut = (F.col("pairs") > bucket) & (F.col("key.end") > F.col("key.start"))
        total, cut = counts.agg(F.sum("rows"), F.bool_or(can_cut)).first()
        if not total:
            break
        span = F.col("end") - F.col("start")
        is_heavy = counts.filter((F.col("rows") * heavy > total) & can_cut).select(F.col("key").alias("h"))  # fewer than heavy
        told = work.join(F.broadcast(is_heavy), F.col("key") == F.col("h"), "left").withColumn("heavy", F.col("h").isNotNull()).drop("h")
        light = told.filter("NOT heavy").drop("heavy")
        small = counts.filter(~can_cut).select("key")
        met = light.join(small, "key", "left_semi")
        u = met.filter("NOT gram").select("key", F.col("word").alias("u"), F.col("n").alias("nu"))
        v = met.filter("gram").select("key", F.col("word").alias("v"), F.col("n").alias("nv"), "longer")
        found.append(written(verified(u.join(v, "key")), f"pairs-{turn}"))
        if not cut:
            break
        big = counts.filter(can_cut).select("key")
        rest = written(told.filter("heavy").drop("heavy").unionByName(light.join(big, "key", "left_semi")), f"rest-{turn}")
        # one code point is all that parts words of equal length here, whatever the bucket's size: they are links
        last = rest.filter(span == 1)
        if not last.isEmpty():
            u = last.filter("NOT gram").select("key", F.col("word").alias("u"), F.col("n").alias("nu"))
            v = last.filter("gram AND longer = 0").select("key", F.col("word").alias("v"), F.col("n").alias("nv"), "longer")
            found.append(written(verified(u.join(v, "key")), f"last-{turn}"))
        work = halves(rest.filter((span > 1) | ~F.col("gram") | (F.col("longer") == 1)))
    return reduce(DataFrame.unionByName, found, words.sparkSession.createDataFrame([], "u string, nu long, v string, nv long"))


def verified(pairs: DataFrame) -> DataFrame:
    """Of equally long words each pair once."""
    return pairs.filter(((F.col("longer") == 1) | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)).select("u", "nu", "v", "nv")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms followed to the last, twice as far in each round."""
    state, turn = written(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        turn += 1
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = written(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{turn}")
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, damage: int = DAMAGE, bucket: int = BUCKET, heavy: int = HEAVY) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = written(word_counts(docs, id_col, text_col, least_chars, least_count, damage), "words")
    pairs = near_pairs(words, bucket, heavy).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("w"), F.col("nu").alias("n"), F.col("v").alias("o"), F.col("nv").alias("no")),
                                          F.struct(F.col("v").alias("w"), F.col("nv").alias("n"), F.col("u").alias("o"), F.col("nu").alias("no")))).alias("e")).select("e.*")
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("no")).alias("k"), "o")).alias("b"), F.first("n").alias("n"))
    fits = -F.col("b.k") >= ratio * F.col("n")
    linked = written(best.select("w", "n_near", F.when(fits, F.col("b.o")).alias("form"), F.when(fits, -F.col("b.k")).alias("form_n")), "near")
    ends = roots(linked.filter("form IS NOT NULL").select(F.col("w").alias("word"), "form"))
    return (words.join(linked, F.col("word") == F.col("w"), "left").join(ends.withColumnRenamed("word", "r"), F.col("word") == F.col("r"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
