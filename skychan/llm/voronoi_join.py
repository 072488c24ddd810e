"""Operator 2: exact n-gram Jaccard join in the metric space of Jaccard distances.

A document's point is its set of distinct word n-grams. Documents with equal sets are one point. Two
points link when their distance is at most r (similarity 0.75: r = 0.25).

First pivots: the one-element sets {g}. All points that hold g are equally near to {g}, so the tie is
broken by one order of all n-grams for everybody (frequent ones last, then by hash): a point's
region is that of its first n-gram. A point within r of it holds all but few of its n-grams, so
replicating every point to the regions of its first n - ceil(0.75 n) + 1 n-grams, its boundary window,
brings every linked pair into a common region.

Within a region sizes are a 1-Lipschitz bound of the distance (d >= 1 - smaller / larger), so points are
sorted by size and a point meets only the window of sizes within r. Small regions of rare n-grams are
joined directly: pairs are candidates if what they share up to the last shared n-gram of their windows, and
what is left behind it, can reach the needed overlap; their distances are computed from the whole texts.

Points whose windows reach frequent n-grams hold all their rare ones in the window. Linked points among them
share a rare one (and meet above) or link by frequent n-grams alone. For these only the ordered
list of frequent n-grams is kept, and points of equal list and size are one. Such regions, whatever their size, and those
of rare n-grams with more than a few points, with whole sets, are joined recursively: in each round points of a region become
pivots (one in the first round), the members' distances to them are taken, members within r link to the pivot only, and the pivot goes. So a group
of near copies gives about as many links as it has points, not as many as it has pairs. A
pair is looked at only if it is not joined by links already, if what follows the region's n-gram in both lists can reach the needed
overlap (true in the region of the first n-gram that they share), and, by the triangle inequality, if the
members' distances to each former lead pivot differ by r at most. (Rare n-grams count as different there,
which is a Jaccard distance too.) The rest chooses new pivots, more of them each time, until all
points of the region are joined or gone. No link is lost; components are those of all links.

N-grams are compared by 64-bit hashes (word hashes, mixed in order), equal sets by a 64-bit digest:
two different n-grams of one pair of documents get the same hash with a chance of about 1e-13.

Defined results. Null, empty or blank text: no n-grams, linked with nothing, its own component (null
doc_id: null). Fewer words than n: the whole sequence is one n-gram. Repeated rows: equal points,
each row comes out. Empty table: no rows. Long texts are read whole; other columns play no part.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import batches_of, erase, plain_texts, repeat_ranges, rows_of, text_digest, words_of, written

WORDS, NUM, DEN = 5, 75, 100
#: An n-gram in the windows of so many points is frequent; the FREQUENT most frequent go last in the order (any order is exact).
OFTEN, FREQUENT = 8, 1_000_000
#: Regions of rare n-grams of up to so many points are joined directly: at most 120 pairs.
FEW = 16
#: A region's members meet its pivots in pieces of about so many.
PIECE = 512
#: A copy of a pivot's set meets about so many points.
MEETS = 256
#: Pivots of a large region: so many times more in each round, up to so many.
GROWTH, MOST_PIVOTS = 16, 4096
#: Bits of a set's parities.
BITS = 1024
#: Regions of rare n-grams that a point's rows name: the first so many of all it is in.
FIRSTS = 8
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Slots that n-grams fall into by their first bits; a slot tells if a frequent one may be there.
SLOT_BITS = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EVEN, _TRUE = np.uint64(0xFFFFFFFFFFFFFFFE), np.array([True])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, A-Z in lower case, and where the words of each text begin (one more than texts)."""
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[o[0]:o[-1]]
    o = o - o[0]
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:len(raw)] = raw | (((raw - np.uint8(0x41)) < 26).view(np.uint8) << np.uint8(5))  # A-Z
    solid = (raw != 0x20) & ((raw - np.uint8(0x09)) > 4)
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(o[1:] > o[:-1])  # a text's ends are ends of words
    begin[o[full]] = solid[o[full]]
    last[o[full + 1] - 1] = solid[o[full + 1] - 1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(last) + 1 - start
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the 8 bytes from each on
    h = length.astype(np.uint64) * _M2

    def mix(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        h = (h ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * _M1
        h ^= h >> np.uint64(32)
        h *= _M2
        h ^= h >> np.uint64(29)
        return h

    if len(start):
        h = mix(h, start, length)
        for k in range(8, LONG_WORD, 8):
            more = np.flatnonzero(length > k)
            if not len(more):
                break
            h[more] = mix(h[more], start[more] + k, length[more] - k)
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(low[start[i]:start[i] + length[i]])
    return h, np.searchsorted(start, o)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes (even numbers) of each text."""
    w, off = word_hashes(texts)

    def mixed(length: int, w: np.ndarray) -> np.ndarray:
        """Of each ``length`` words in a row."""
        count = len(w) - length + 1
        h = w[:count] + np.uint64(length)
        for k in range(1, length):
            h *= _M1
            h += w[k:count + k]
        h ^= h >> np.uint64(32)
        h *= _M2
        h ^= h >> np.uint64(29)
        h *= _M1
        h ^= h >> np.uint64(32)
        h &= _EVEN
        return h

    flat = mixed(n, w) if len(w) >= n else w[:0]  # of a text's last words on: not used
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a < n:
            out.append(mixed(b - a, w[a:b]) if b > a else w[:0])
            continue
        s = np.sort(flat[a:b - n + 1])
        new = s[1:] != s[:-1]
        out.append(s if new.all() else s[np.concatenate([_TRUE, new])])
    return out


def window_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def point_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def parities(s: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of how many members of a set fall there: two sets differ in at least as many members as bits."""
    at = (s.astype(np.uint64) * _M1) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view("<i8")


def frequent_grams(docs: DataFrame, text_col: str, n: int, num: int, den: int, often: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the most points, ``most`` at most, by hash, and the place of each in the order of all (most frequent last).
    Counted over all documents: those in windows, and those behind that a slice of the table has twice (windows get longer
    as frequent ones go last). Any choice gives an exact join."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches_of(it, limit=6_000_000):
            sets = {point_of(s): s for s in shingle_sets(texts, n) if len(s)}
            if sets:
                size = np.fromiter(map(len, sets.values()), np.int64, len(sets))
                behind = window_length(size, num, den)
                g = np.concatenate([*sets.values()])
                g[repeat_ranges(np.cumsum(size) - size + behind, size - behind)] |= ~_EVEN  # those behind windows come after equal ones in them
                g.sort()
                near = (g & ~_EVEN) == 0
                g &= _EVEN
                first = np.flatnonzero(np.concatenate([_TRUE, g[1:] != g[:-1]]))
                c = np.diff(first, append=len(g))
                some = (c > 1) | near[first]
                yield pa.RecordBatch.from_arrays([pa.array(g[first[some]].view(np.int64)), pa.array(c[some].astype(np.int64))], ["g", "c"])

    counts = written(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).filter(F.col("c") >= often), "counts", tidy=True)
    rows = counts.orderBy(F.desc("c"), "g").limit(most).select("g").toPandas()  # most rows at most
    g = rows["g"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(g)
    return g[by_hash], (len(g) - 1 - by_hash).astype(np.int32)


def slots(frequent: np.ndarray) -> np.ndarray:
    """Which slots hold a frequent n-gram."""
    out = np.zeros(1 << SLOT_BITS, bool)
    out[frequent >> np.uint64(64 - SLOT_BITS)] = True
    return out


def split_set(s: np.ndarray, frequent: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare n-grams of a set, and the indices in ``frequent`` of the others. ``slot``: those of ``frequent``."""
    maybe = np.flatnonzero(slot[s >> np.uint64(64 - SLOT_BITS)])
    if not len(maybe):
        return s, maybe
    at = np.minimum(np.searchsorted(frequent, s[maybe]), len(frequent) - 1)
    often = frequent[at] == s[maybe]
    rare = np.ones(len(s), bool)
    rare[maybe[often]] = False
    return s[rare], at[often]


def windows(docs: DataFrame, text_col: str, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """A row for each point and rare n-gram of its window: g, x, n, pos (place in the point's order)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # a fixed size at most

    def emit(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        last = shared.value
        slot = slots(last)
        for _, texts in batches_of(it):
            g, x, size = [], [], []
            for s in shingle_sets(texts, n):
                p = point_of(s)
                if not len(s) or p in done:
                    continue
                done.add(p)
                g.append(split_set(s, last, slot)[0][:window_length(len(s), num, den)])
                x.append(p)
                size.append(len(s))
            if g:
                each = np.fromiter(map(len, g), np.int64, len(g))
                rep = lambda v, t, e=each: pa.array(np.repeat(np.array(v, t), e))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g).view(np.int64)), rep(x, np.int64), rep(size, np.int32),
                                                  pa.array(repeat_ranges(np.zeros(len(g), np.int64), each).astype(np.int32))], ["g", "x", "n", "pos"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(emit, "g long, x long, n int, pos int")


def points(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, frequent: np.ndarray, place: np.ndarray) -> DataFrame:
    """Table of doc_id, _digest, x (point), n (n-grams) of every row. Of points whose windows reach frequent n-grams, too: s (places of all their
    frequent n-grams, in order; all their rare ones are in the window), sig (parities of s), key (digest of n and s)."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, place))  # a fixed size at most

    def digest(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, order = shared.value
        slot = slots(last)
        for batch, texts in batches_of(it):
            x, size, own, sig, key = [], [], [], [], []
            for s in shingle_sets(texts, n):
                rare, at = split_set(s, last, slot)
                hot = np.sort(order[at]) if len(s) and len(rare) < window_length(len(s), num, den) else None
                x.append(point_of(s))
                size.append(len(s))
                own.append(hot)
                sig.append(None if hot is None else parities(hot))
                key.append(None if hot is None else xxhash.xxh3_64_intdigest(hot.tobytes(), seed=len(s)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_digest"), pa.array(x, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(sig, pa.list_(pa.int64())), pa.array(key, pa.int64())],
                                             ["doc_id", "_digest", "x", "n", "s", "sig", "key"])

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("_digest"), F.col(text_col).alias("text"))
                   .mapInArrow(digest, "doc_id long, _digest string, x long, n long, s array<int>, sig array<bigint>, key long"), "points", tidy=True)


def whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """x, n, s (all n-gram hashes), sig (their parities) of points given by x, text."""

    def emit(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in batches_of(it):
            sets = shingle_sets(part, n)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))], ["x", "n", "s", "sig"])

    return texts.select("x", "text").mapInArrow(emit, "x long, n long, s array<bigint>, sig array<bigint>")


def join_regions(rows: DataFrame, num: int, den: int, few: int) -> DataFrame:
    """Small regions joined: pairs (x, y) whose sizes and places allow a link. Rows of larger regions come back with y null. Regions that only one point is in go."""
    names = ["g", "x", "y", "nx", "ny", "px", "py"]

    def pairs(a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, x, n, pos = (a[c] for c in ("g", "x", "n", "pos"))
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        of = np.repeat(size, size)
        large = np.flatnonzero(of > few)
        if len(large):
            k = len(large)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g[large]), pa.array(x[large]), none, pa.array(n[large]), none, pa.array(pos[large]), none], names)
        i = np.flatnonzero((of > 1) & (of <= few))
        step = 1
        while len(i):
            j = i + step
            ok = j < len(g)
            i, j = i[ok], j[ok]
            ok = (g[i] == g[j]) & (n[i] * den >= n[j] * num)  # sorted by size: further ones are larger still
            i, j = i[ok], j[ok]
            need = -(-num * (n[i] + n[j]) // (num + den))
            fits = (x[i] != x[j]) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= need)
            if fits.any():
                a_, b_ = i[fits], j[fits]
                swap = x[a_] > x[b_]
                a_, b_ = np.where(swap, b_, a_), np.where(swap, a_, b_)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g[a_], x[a_], x[b_], n[a_], n[b_], pos[a_], pos[b_])], names)
            step += 1

    def stream(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {c: [] for c in ("g", "x", "n", "pos")}
        for batch in it:
            own = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in kept}
            if not len(own["g"]):
                continue
            cut = int(np.searchsorted(own["g"], own["g"][-1]))  # the last region may go on in the next batch
            if cut or (kept["g"] and kept["g"][0][0] != own["g"][0]):
                done = {c: np.concatenate([*kept[c], own[c][:cut]]) for c in kept}
                if len(done["g"]):
                    yield from pairs(done)
                kept = {c: [own[c][cut:]] for c in kept}
            else:
                for c in kept:
                    kept[c].append(own[c])
        if kept["g"]:
            yield from pairs({c: np.concatenate(v) for c, v in kept.items()})

    return (rows.select("g", "x", "n", "pos").repartition("g").sortWithinPartitions("g", "n", "x")
            .mapInArrow(stream, "g long, x long, y long, nx long, ny long, px long, py long"))


def candidates(pairs: DataFrame, large: DataFrame, num: int, den: int) -> DataFrame:
    """x, y of pairs that can reach the needed overlap: what they share up to the last shared n-gram, what can follow it (all frequent ones do), and what large regions, which list no pairs, may hide."""
    p = pairs.groupBy("x", "y").agg(F.count_distinct("g").alias("c"), F.max("px").alias("px"), F.max("py").alias("py"), *(F.first(c).alias(c) for c in ("nx", "ny")))
    if not large.isEmpty():
        more = written(large.groupBy("x").agg(F.count_distinct("g").alias("k")), "large-counts", tidy=True)
        for side in ("x", "y"):
            p = p.join(more.select(F.col("x").alias("m"), F.col("k").alias(f"k{side}")), F.col(side) == F.col("m"), "left").drop("m")
    else:
        p = p.withColumn("kx", F.lit(0)).withColumn("ky", F.lit(0))
    hidden = F.least(F.coalesce("kx", F.lit(0)), F.coalesce("ky", F.lit(0)))
    most = F.col("c") + hidden + F.least(F.col("nx") - F.col("px") - 1, F.col("ny") - F.col("py") - 1)
    return p.filter(most * (num + den) >= num * (F.col("nx") + F.col("ny"))).select("x", "y")


def distances(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """x, y, common, union of each pair, from the whole texts."""

    def compare(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            tx, ty = plain_texts(batch.column("tx")), plain_texts(batch.column("ty"))
            for a in range(0, len(x), 256):
                k = len(x[a:a + 256])
                known: dict[int, np.ndarray] = {}
                for ids, side in ((x, tx), (y, ty)):
                    new = {p: i for i, p in enumerate(ids[a:a + k]) if p not in known}
                    known.update(zip(new, shingle_sets(side.slice(a, k).take(pa.array(list(new.values()), pa.int64())), n), strict=True))
                common = [len(np.intersect1d(known[p], known[q], assume_unique=True)) for p, q in zip(x[a:a + k], y[a:a + k], strict=True)]
                union = [len(known[p]) + len(known[q]) - c for p, q, c in zip(x[a:a + k], y[a:a + k], common, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x[a:a + k], pa.int64()), pa.array(y[a:a + k], pa.int64()), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["x", "y", "common", "union"])

    t = texts.select(F.col("x").alias("p"), "text")
    both = (pairs.join(t.withColumnRenamed("text", "tx"), F.col("x") == F.col("p")).drop("p")
            .join(t.withColumnRenamed("text", "ty"), F.col("y") == F.col("p")).select("x", "y", "tx", "ty"))
    return both.mapInArrow(compare, "x long, y long, common long, union long")


def cells(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Regions of sets by the n-grams of their windows: g, x, n, size (of s), pos (place of g in s). And x, window, sig."""
    wide = F.col("size") - F.ceil(F.col("n") * num / den).cast("int") + 1
    own = sets.withColumn("size", F.size("s")).filter(wide > 0).withColumn("window", F.slice("s", F.lit(1), wide))
    rows = own.select("x", "n", "size", F.posexplode("window").alias("pos", "g"))
    return rows.select(F.col("g").cast("long").alias("g"), "x", "n", "size", "pos"), own.select("x", "window", "sig")


def rare_cells(large: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``large`` for ``join_cells``; and x, sig, the first regions of each point in one order of all (``window``): of two points that share one of those,
    the first that they share is the first of all that they share, so they meet there only; others meet in each region that they share."""
    firsts = large.groupBy("x").agg(F.slice(F.array_sort(F.collect_set("g")), 1, FIRSTS).alias("window"))
    return large.distinct().select("g", "x", "n", F.col("n").alias("size"), F.lit(0).alias("pos")), sets.select("x", "sig").join(firsts, "x")


def overlaps(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """x, p, common, union of pairs of a point x and a pivot p. The set of a pivot that meets many points is dealt out in as many copies as it needs."""
    copies = F.ceil(F.col("k") / MEETS)
    few = asked.groupBy("p").agg(F.count("*").alias("k"))
    of_pivots = few.join(sets, F.col("p") == F.col("x")).select("p", F.col("n").alias("pn"), F.col("s").alias("ps"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
    dealt = asked.join(few, "p").select("x", "p", F.pmod(F.xxhash64("x"), copies).alias("salt"))
    return (dealt.join(sets, "x").join(of_pivots, ["p", "salt"])
            .select("x", "p", "n", "pn", F.size(F.array_intersect("s", "ps")).cast("long").alias("common"))
            .select("x", "p", "common", (F.col("n") + F.col("pn") - F.col("common")).alias("union")))


def join_cells(work: DataFrame, signs: DataFrame, sets: DataFrame, links: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """As many links as points that connect what ``links`` and those of regions of any size connect, round by round: see the module's text. ``work``: g, x, n, size, pos;
    ``signs``: x, window (regions that x is in, the first ones in one order of all), sig; ``sets``: x, n, s; ``links``: those known before. Points that links join already need no distance,
    and a region whose points are all joined is done. Rows of ``work`` get the wide columns of ``signs`` only where they meet pivots."""
    r = 1 - num / den
    rest = ["g", "x", "n", "size", "pos", "rings"]
    signs = written(signs, f"{name}-signs", tidy=True)
    work = work.withColumn("rings", F.array().cast("array<double>"))
    turn, before = 0, []
    while True:
        joined, links = joined_points(links)  # it only saves distances; links are one table again, so each round has the same plans
        own = work.join(joined.withColumnRenamed("x", "j"), F.col("x") == F.col("j"), "left").select(*rest, F.coalesce("label", "x").alias("label"))
        groups = own.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("members")).filter("a != b").select("g", "members")
        work = written(own.join(groups, "g"), f"{name}-{turn}-open", tidy=True)
        erase(joined, *before)
        if work.isEmpty():
            return links
        turn += 1
        h = F.xxhash64("x", F.lit(f"{turn}"))  # a text: the same code in each round
        most = min(GROWTH ** (turn - 1), MOST_PIVOTS)
        part = F.when(F.col("members") > most, F.pmod(h, F.lit(most))).otherwise(h)  # where all can be pivots, the region is done in this round
        # points of small components first: those of a large one then meet few others
        size = work.groupBy("g", "label").agg(F.count("*").alias("k"))
        chosen = (work.join(size, ["g", "label"]).groupBy("g", part.alias("b"))
                  .agg(F.min(F.struct("k", h.alias("h"), "x")).alias("p")).select("g", F.col("p.x").alias("x"), (F.col("b") == 0).alias("lead")))
        marked = written(work.join(chosen, ["g", "x"], "left"), f"{name}-{turn}-marked", tidy=True)
        pivots = marked.filter("lead IS NOT NULL").join(signs, "x").select("g", "members", *(F.col(c).alias(f"p{c}") for c in ("x", "n", "size", "pos", "window", "sig", "rings", "label")))
        # of two pivots one asks; a pair meets in the region of the first n-gram that their windows share, only; what follows must suffice, and what the parities
        # leave to be shared; rings of width r around former pivots
        first_shared = F.coalesce(F.get(F.array_intersect("window", "pwindow"), F.lit(0)).cast("long") == F.col("g"), F.lit(True))
        differ = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("psig")[i])) for i in range(BITS // 64)), F.lit(0))
        fits = ((F.col("lead").isNull() | (F.col("px") < F.col("x"))) & (F.col("label") != F.col("plabel"))
                & (F.least(F.col("size") - F.col("pos"), F.col("psize") - F.col("ppos")) * (num + den) >= (F.col("n") + F.col("pn")) * num)
                & ((F.col("size") + F.col("psize") - differ) * (num + den) >= (F.col("n") + F.col("pn")) * 2 * num) & first_shared
                & ~F.exists(F.zip_with("rings", "prings", lambda a, b: F.coalesce(F.abs(a - b) > r + 1e-9, F.lit(False))), lambda v: v))
        # a region's rows are dealt out in pieces, each of which meets all its pivots
        pieces = F.ceil(F.col("members") / PIECE)
        dealt = marked.join(signs, "x").withColumn("piece", F.pmod(F.xxhash64("x"), pieces))
        copies = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("members")
        met = dealt.join(copies, ["g", "piece"]).filter(fits).select("x", F.col("px").alias("p")).distinct()
        known = written(overlaps(met, sets), f"{name}-{turn}-overlaps", tidy=True)
        more = known.filter(F.col("common") * den >= F.col("union") * num).select(F.least("x", "p").alias("x"), F.greatest("x", "p").alias("y"))
        given, links = links, links.unionByName(more)
        left = marked.filter("lead IS NULL")
        first = marked.filter("lead").select("g", F.col("x").alias("p"))
        ring = known.select("x", "p", (1 - F.col("common") / F.col("union")).alias("d"))
        done = work
        work = written(left.join(first, "g", "left").join(ring, ["x", "p"], "left").withColumn("rings", F.concat("rings", F.array("d"))).select(*rest), f"{name}-{turn}", tidy=True)
        erase(done, marked)
        before = [work, known, given]


def both_ways(links: DataFrame) -> DataFrame:
    """a, b of each link in both directions."""
    return links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b")))


def spread(both: DataFrame, state: DataFrame) -> DataFrame:
    """Labels (x, m, was) after a step along links."""
    heard = both.join(state.select(F.col("x").alias("b"), "m"), "b").groupBy(F.col("a").alias("x")).agg(F.min("m").alias("o"))
    return state.join(heard, "x").select("x", F.least("m", "o").alias("m"), F.col("m").alias("was"))


def jumped(new: DataFrame) -> DataFrame:
    """Labels after a step along labels."""
    return new.join(new.select(F.col("x").alias("m"), F.col("m").alias("j")), "m", "left").select("x", F.least("m", "j").alias("m"), "was")


def joined_points(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x, label after two rounds: equal labels mean joined points, but joined points may have different ones. And x, y: each point's link to its label and the links
    between different labels, which join what ``links`` join with about as many rows as points."""
    both = both_ways(links)
    near = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("o")).select("x", F.least("x", "o").alias("m"), F.col("x").alias("was"))
    state = written(jumped(near).select("x", "m"), "near", tidy=True)
    label = written(jumped(spread(both, state)).select("x", F.col("m").alias("label")), "joined", tidy=True)
    of = lambda c: label.select(F.col("x").alias(c), F.col("label").alias(f"l{c}"))
    across = links.select(F.col("x").alias("a"), F.col("y").alias("b")).join(of("a"), "a").join(of("b"), "b").filter("la != lb").select(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y"))
    fewer = written(label.filter("label != x").select(F.col("label").alias("x"), F.col("x").alias("y")).unionByName(across).distinct(), "fewer-links", tidy=True)
    erase(state)
    return label, fewer


def components(links: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """x, m, label: the least point reachable by links (never null), and the least name among those points (``names``: x, label), without names ``m`` again. Labels spread along
    links and along themselves, so chains take a logarithm of their length in rounds."""
    both = written(both_ways(links).distinct(), "links", tidy=True)
    state = written(both.select(F.col("a").alias("x")).distinct().withColumn("m", F.col("x")), "label-0", tidy=True)
    turn = 0
    while True:
        turn += 1
        new = written(spread(both, state), f"heard-{turn}", tidy=True)
        old, state = state, written(jumped(new), f"label-{turn}", tidy=True)
        erase(old, new)
        if state.filter("m != was").isEmpty():
            erase(both)
            break
    if names is None:
        return state.select("x", "m", F.col("m").alias("label"))
    named = state.select("x", "m").join(names, "x")
    return named.join(named.groupBy("m").agg(F.min("label").alias("least")), "m").select("x", "m", F.col("least").alias("label"))


def join_frequent(hot: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect what ``links`` and those between points whose frequent n-grams alone make a link (others have a rare one in common) connect.

    Points of equal n and equal frequent n-grams are a class; one of them stands for all. A class is tight if its members link to one another."""
    sets = written(hot.groupBy("key").agg(F.min("x").alias("x"), *(F.first(c).alias(c) for c in ("n", "s", "sig"))), "classes", tidy=True)
    tight = F.size("s") * (num + den) >= 2 * F.col("n") * num
    of = sets.select("key", F.col("x").alias("rep"), tight.alias("tight"))
    others = written(hot.select("key", "x").distinct().join(of, "key").filter("x != rep").select("rep", "x", "tight"), "members", tidy=True)
    links = links.unionByName(others.filter("tight").select(F.col("rep").alias("x"), F.col("x").alias("y")))
    found = join_cells(*cells(sets, num, den), sets.select("x", "n", "s"), links, num, den, "frequent")
    # members of a class that isn't tight link to what the class's point links to, too, so they are in its component if it has a link
    both = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
    loose = others.filter("NOT tight").select(F.col("rep").alias("x"), F.col("x").alias("member")).join(both, "x").select(F.col("member").alias("x"), "y")
    return written(found.unionByName(loose), "frequent-links", tidy=True)


def open_pairs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that ``links`` don't join already."""
    label, _ = joined_points(links)
    for side in ("x", "y"):
        pairs = pairs.join(label.select(F.col("x").alias("m"), F.col("label").alias(f"l{side}")), F.col(side) == F.col("m"), "left").drop("m")
    return pairs.filter("lx IS NULL OR ly IS NULL OR lx != ly").select("x", "y")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, num: int = NUM, den: int = DEN,
           often: int = OFTEN, most: int = FREQUENT, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id, the text's _digest and _component (least point of the component, null only without n-grams) of every row.
    Points are linked if den * common >= num * union."""
    frequent, place = frequent_grams(docs, text_col, n, num, den, often, most)
    rows = points(docs, id_col, text_col, n, num, den, frequent, place)
    # regions of rare n-grams: small ones give pairs, rows of large ones come back
    met = written(join_regions(windows(docs, text_col, n, num, den, frequent), num, den, few), "met", tidy=True)
    large = written(met.filter("y IS NULL").select("g", "x", F.col("nx").alias("n")), "large", tidy=True)
    pairs = written(candidates(met.filter("y IS NOT NULL"), large, num, den), "candidates", tidy=True)
    erase(met)
    links = docs.sparkSession.createDataFrame([], "x long, y long")
    if len(frequent):
        links = join_frequent(rows.filter("key IS NOT NULL").select("x", "n", "s", "sig", "key"), links, num, den)
        all_, pairs = pairs, written(open_pairs(pairs, links), "open-pairs", tidy=True)
        erase(all_)
    # the texts of the points that need distances, by one row of each
    needed = pairs.select("x").union(pairs.select("y")).union(large.select("x")).distinct()
    first = rows.join(needed, "x", "left_semi").groupBy("x").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_digest")).alias("r")).select("x", F.col("r.doc_id").alias("_id"), F.col("r._digest").alias("_digest"))
    texts = written(rows_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), written(first, "first", tidy=True), "doc_id", "text").select("x", "text"), "texts", tidy=True)
    links = links.unionByName(written(distances(pairs, texts, n).filter(F.col("common") * den >= F.col("union") * num).select("x", "y"), "pair-links", tidy=True))
    if not large.isEmpty():
        sets = written(whole_sets(texts.join(large.select("x").distinct(), "x", "left_semi"), n), "whole-sets", tidy=True)
        links = join_cells(*rare_cells(large, sets), sets, links, num, den, "rare")
    names = written(rows.filter("n > 0").groupBy("x").agg(F.min("doc_id").alias("label")), "names", tidy=True)
    found = components(links, names)
    label = written(names.join(found.withColumnRenamed("label", "l"), "x", "left").select(F.col("x").alias("lx"), F.coalesce("l", "label").alias("label"), F.coalesce("m", "x").alias("_component")), "labels", tidy=True)
    return (rows.join(label, (rows["x"] == label["lx"]) & (rows["n"] > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), "_digest", "_component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (null last, then text digest), and all without n-grams.
    Components are told apart by their points: component_id is null for each whose rows all have a null doc_id."""
    found = linked(docs, id_col, text_col, **options)
    stays = found.filter("n_shingles > 0").groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_digest")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r._digest").alias("_digest"))
    blank = found.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"), "_digest").distinct()
    return rows_of(docs, written(stays.unionByName(blank), "stays", tidy=True), id_col, text_col)
