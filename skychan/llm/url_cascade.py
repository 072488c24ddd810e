"""Operator 13: URL rules looked up in Bloom filter cascades, exact over the corpus's keys.

A key is a host and the beginning of a path, written one after the other (``example.net/en/``). The keys
of a url are those that could be a rule: the last 1, 2, ... labels of its host, as many as the longest
host of a rule has, each with the beginnings of its path that are as long as some rule's path. The
corpus's key universe is the keys of all its urls.

A cascade encodes the listed keys. Level 1 is a Bloom filter of them; level 2 holds the keys of the
universe that level 1 takes wrongly; level 3 the listed keys that level 2 takes wrongly; and so on until
a level takes none wrongly. A key is looked up level by level; the first level that doesn't have it
says what it is. The build ends only when no key of the universe is misjudged, so the answer
is exact for all of them, and no url is joined with the list. Level 1 keeps about as many wrong keys
as there are listed ones; only these are made distinct and shuffled, never the universe.

There is one cascade of the block rules and one of the allow rules. The longest key of a url that is in
either is the rule that fits it; without one the url is allowed, as no cascade lists it.

Filters are broadcast, so lists are cut by key hash into shards of at most ``shard_keys`` keys, whose
cascades are built, applied to all rows and dropped, one after another: a shard's filters take at most
about 6 bytes a key.

Defined results. Null url or one without ``://``: host and path empty, rule null, allow. A path that is
empty doesn't start with ``/``, so rules with a path don't fit it. Ports and user names belong to the host as
written. Rules of equal length: the one with the longer host. A rule given as block and as allow: block.
Rules with a null host count as absent, a null path as empty. Repeated rows: each comes out. Null page_id: a
row like others. Empty table: no rows; empty list: all urls allowed. Very long urls: whole, but only as much
of them as a rule could cover is looked up. Other columns of the input play no part.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import written

#: Listed keys of a shard at most: the bound on what is broadcast.
SHARD_KEYS = 8_000_000
#: A cascade has a few levels more than the logarithm of its keys; many more mean two keys of one 128-bit hash.
MOST_LEVELS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)
ALLOW, BLOCK = 1, 2


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bits in words of 64, and how many bits a key sets."""
    words: np.ndarray
    hashes: int

    def has(self, a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
        found = np.ones(len(a), bool)
        for at in slots(a, b, number, self.hashes, 64 * len(self.words)):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def slots(a: np.ndarray, b: np.ndarray, number: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """The bits that keys of hashes ``a``, ``b`` set in level ``number``: other ones in each level."""
    with np.errstate(over="ignore"):
        a, b = a.view(np.uint64), b.view(np.uint64)
        h = (a ^ (np.uint64(number) * _MIX)) * _MIX
        h ^= h >> np.uint64(32)
        h = (h + b) * _MIX
        step = (b ^ (h >> np.uint64(29))) | np.uint64(1)
        for i in range(hashes):
            h = h + step
            m = h ^ (h >> np.uint64(31))
            yield (m * _MIX >> np.uint64(11)) % np.uint64(bits)


def holds(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys a cascade lists."""
    listed = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for i, level in enumerate(levels):
        has = level.has(a[open_], b[open_], i + 1)
        listed[open_[~has]] = i % 2 == 1
        open_ = open_[has]
    listed[open_] = len(levels) % 2 == 1
    return listed


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def bloom(keys: DataFrame, count: int, wrong: float, number: int) -> Level:
    """The filter of all ``keys`` (a, b): each task sets bits, Spark joins them word by word."""
    hashes = max(1, round(-np.log2(wrong)))
    size = max(1, int(np.ceil(count * hashes / np.log(2) / 64)))

    def bits(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = numbers(batch, "a", "b")
            if len(a):
                at = np.unique(np.concatenate([*slots(a, b, number, hashes, 64 * size)]))
                word = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(value.view(np.int64))], ["word", "value"])

    set_ = keys.select("a", "b").mapInArrow(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # a word of the filter each
    words = np.zeros(size, np.uint64)
    words[set_.column("word").to_numpy()] = set_.column("value").to_numpy().view(np.uint64)
    return Level(words, hashes)


def passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """The keys (key, a, b) that a level takes."""
    shared = keys.sparkSession.sparkContext.broadcast(level)  # at most a shard's filter

    def test(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(shared.value.has(*numbers(batch, "a", "b"), number)))

    return keys.select("key", "a", "b").mapInArrow(test, "key string, a long, b long")


def cascade(listed: DataFrame, universe: DataFrame, name: str = "cascade") -> list[Level]:
    """Levels for the distinct keys of ``listed`` (key) that are right for every key of ``universe`` (key, repeats allowed)."""
    encoded = written(listed.select("key").distinct().select("key", *hashed(F.col("key"))), f"{name}-listed")
    count = encoded.count()
    if not count:
        return []
    universe = universe.select("key", *hashed(F.col("key")))
    there = max(1, universe.agg(F.approx_count_distinct("a")).first()[0])
    wrong = float(min(0.5, max(2.0 ** -40, count / there * 0.5 ** 0.5)))
    levels = [bloom(encoded, count, wrong, 1)]
    against = written(passing(universe, levels[0], 1).distinct().join(encoded, "key", "left_anti"), f"{name}-1")
    while True:
        count = against.count()
        if not count:
            return levels
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys have the same 128-bit hash")
        number = len(levels) + 1
        levels.append(bloom(against, count, 0.5, number))
        # what this level takes wrongly of the other side goes into the next one
        encoded, against = against, written(passing(encoded, levels[-1], number), f"{name}-{number}")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The keys of a url, longest first (of equally long ones that with the longer host)."""
    ends = F.array_distinct(F.array(*(F.substring_index(host, ".", -k) for k in range(1, labels + 1))))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    each = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.struct((-F.length(h) - F.length(p)).alias("k"), (-F.length(h)).alias("h"), F.concat(h, p).alias("key")))))
    return F.array_sort(each)["key"]


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule (of the list, or null), verdict ("allow" or "block") of every row. ``rules``: host, path, verdict ("allow" or "block")."""
    rules = written(rules.filter("host IS NOT NULL AND verdict IN ('allow', 'block')").select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"),
                    F.size(F.split("host", "\\.")).alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("chars"), "verdict")
                    .groupBy("key").agg(F.max("labels").alias("labels"), F.min("chars").alias("chars"), F.max("verdict").alias("verdict")), "rules")
    lengths = sorted(r[0] for r in rules.select("chars").distinct().collect())  # lengths of paths: few, and no longer than a url
    count, labels = rules.agg(F.count("*"), F.max("labels")).first()
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    none = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    if not count:
        return none
    asked = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, lengths)).withColumn("found", F.lit(0)).withColumn("kind", F.lit(0))
    shards = -(-count // shard_keys)
    for shard in range(shards):
        own = (lambda c, s=shard: F.pmod(F.xxhash64(F.lit("shard"), c), F.lit(shards)) == s)
        universe = asked.select(F.explode("keys").alias("key")).filter(own(F.col("key")))
        both = [cascade(rules.filter(F.col("verdict") == v).filter(own(F.col("key"))), universe, f"{v}-{shard}") for v in ("allow", "block")]
        asked = looked_up(asked, both)
        if shard + 1 < shards:
            asked = written(asked, f"asked-{shard}")
    return asked.select("page_id", "host", "path", F.when(F.col("found") > 0, F.element_at("keys", F.col("found"))).alias("rule"),
                        F.when(F.col("kind") == BLOCK, "block").otherwise("allow").alias("verdict"))


def looked_up(asked: DataFrame, both: list[list[Level]]) -> DataFrame:
    """``found`` (place of the longest key listed so far, 0: none) and ``kind`` after one more shard's cascades."""
    shared = asked.sparkSession.sparkContext.broadcast(both)  # at most a shard's filters
    pairs = F.transform("keys", lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b")))

    def look(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            each = batch.column("pairs")
            size = each.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = each.flatten()
            a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            kind = np.zeros(len(a), np.int32)
            for what, levels in zip((ALLOW, BLOCK), shared.value, strict=True):
                kind[holds(levels, a, b)] = what
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(kind)[::-1]
            old, old_kind = numbers(batch, "found", "kind")
            found, is_ = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            found[row[hits]], is_[row[hits]] = hits - first[row[hits]] + 1, kind[hits]  # the first hit of a row is written last
            keep = (old > 0) & ((found == 0) | (old < found))
            done = [pa.array(np.where(keep, old, found).astype(np.int32)), pa.array(np.where(keep, old_kind, is_).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "keys")), *done], ["page_id", "host", "path", "keys", "found", "kind"])

    kept = asked.select("page_id", "host", "path", "keys", "found", "kind")
    return kept.withColumn("pairs", pairs).mapInArrow(look, kept.schema)
