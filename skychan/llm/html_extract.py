"""Operator 1: main text of web pages by suffix arrays over the pages of a host.

A page is cut into blocks (html_blocks.py). All of them, those of the article too, make up the page's
token stream; what can be main text are the blocks that structure doesn't name a menu, an advert, a form
or the like and, where an article or main element has text, only those in it. The streams of a host's
pages are concatenated and their suffixes sorted (a suffix array by prefix doubling). A run of at least
MIN_RUN tokens is boilerplate if it stands in enough different pages of the host: three, or half the
square root of their number if that is more, as ordinary phrases repeat by chance on a large host. Of
what can be main text the stretches that such runs cover go, if they are MIN_RUN tokens long or a whole
block; the unique runs of a block stay.

Copies of an article are not templates: pages of a host whose texts cover each other to COPY at least are one
page when runs are counted. Candidates share a band of a min-hash sketch; each is compared in full with
the least page of its band, and pages joined by such pairs are one.

A large host is dealt to shards of a bounded number of tokens. Each shard sorts its own suffixes and adds the
pages of each of its runs to a count sketch of SLOTS places by run hash; the shards' sketches are summed. A run whose
place stays below the needed number can't be repeated often enough. Of the others every shard tells
the pages and places they stand in, and these are counted exactly, by run, over the whole host: the sketch only saves moving
the rest. What moves is proportional to the tokens of a host: a bit a slot to each shard, and each run's places once
(where a host is so large that its sketch is full, all of them). Texts meet only the cuts of their page. Shards are dealt in TURNS
turns, and shuffle files go once a table is written, so that a part of the streams is on disk at a time.

Defined results. Null or empty html, or no main text: empty text, n_chars 0. Null url: one host of
its own. Null page_id and repeated rows: rows like others; rows with the same stream count as one
page. Long pages are read whole. Empty table: no rows. White space is what Unicode calls so.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.llm import common
from skychan.llm.common import batches_of, erase
from skychan.llm.html_blocks import DROP, blocks
from skychan.llm.voronoi_join import components

#: Tokens of a run that counts as long.
MIN_RUN = 8
#: Different pages that a boilerplate run stands in, at least.
MIN_PAGES = 3
#: Pages of a host whose texts cover each other to this share are one page.
COPY = 0.8
#: Tokens of a shard of a host.
SHARD_TOKENS = 1_000_000
#: Turns in which shards are dealt, so that a part of the streams is on disk at a time.
TURNS = 2
#: Places of the bitmap of pages that may be copies.
MARKS = 1 << 23
#: Bands of a text's sketch, min-hashes of a band, tokens of what is hashed.
BANDS, ROWS, GRAM = 16, 3, 3
#: Places of a host's sketch, and how many of them are a row.
SLOTS, CELLS = 1 << 21, 1 << 16
written = partial(common.written, tidy=True)
SEEDS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64)
PARSED = "page_id long, url string, host string, texts array<string>, page long, n_stream long, sizes binary, bands array<long>"


def tokens_by_block(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words of all blocks in a row, and where those of each begin (one more than blocks). Each distinct word is hashed once."""
    parts = pc.split_pattern(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), " ")
    words = pc.dictionary_encode(parts.flatten())
    count = len(words.dictionary)
    edges = np.frombuffer(words.dictionary.buffers()[1], np.int64)[words.dictionary.offset:][:count + 1].tolist()
    spelled = words.dictionary.buffers()[2]
    spelled = b"" if spelled is None else spelled.to_pybytes()
    token = np.fromiter((xxhash.xxh3_64_intdigest(spelled[i:j]) & 0xFFFFFFFF for i, j in zip(edges, edges[1:], strict=False)), np.uint32, count)
    return token[words.indices.to_numpy(zero_copy_only=False)].astype("<u4"), parts.offsets.to_numpy(zero_copy_only=False)


def run_hashes(stream: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` tokens from each position; a shorter stream is one run."""
    n = max(1, len(stream) - length + 1) if len(stream) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(length, len(stream))):
        h = (h ^ stream[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def sketch(tokens: np.ndarray) -> list[int]:
    """Keys of the bands of a text; two texts share each with the third power of the share of grams they have in common."""
    if not len(tokens):
        return []
    grams = np.unique(run_hashes(tokens, GRAM))
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for i in range(0, len(grams), 2048):
        np.minimum(least, ((grams[i:i + 2048] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes()) >> 1 for row in least.reshape(BANDS, ROWS)]


def slots_of(runs: np.ndarray) -> np.ndarray:
    return (runs & np.uint64(SLOTS - 1)).astype(np.int64)


def text_tokens(stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return stream[np.repeat(sizes > 0, np.abs(sizes))]


def tokens_of(stream: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(stream, "<u4").astype(np.uint64)


def spread(hit: np.ndarray, length: int, min_run: int) -> np.ndarray:
    """Whether each of ``length`` tokens lies in a run that begins where ``hit`` says."""
    covered = np.zeros(length + min_run, bool)
    for k in range(min_run):
        covered[k:k + len(hit)] |= hit
    return covered[:length]


def covered_by(stream: np.ndarray, runs: np.ndarray, min_run: int) -> np.ndarray:
    """Whether each token lies in one of the runs."""
    return spread(np.isin(run_hashes(stream, min_run), runs), len(stream), min_run)


def cuts_of(covered: np.ndarray, sizes: np.ndarray, min_run: int) -> bytes:
    """The covered stretches of texts that are ``min_run`` long or a whole block: (block, from, to) in a row."""
    cuts, block = [], -1
    for size, a in zip(sizes.tolist(), np.r_[0, np.cumsum(np.abs(sizes))].tolist(), strict=False):
        if size <= 0:
            continue
        block += 1
        turns = np.flatnonzero(np.diff(np.r_[False, covered[a:a + size], False]))
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if j - i >= min_run or j - i == size:
                cuts += [block, i, j]
    return np.array(cuts, "<i4").tobytes()


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages cut into blocks, as a table; see PARSED. ``texts`` holds all blocks, ``sizes`` the tokens of each (negative: it can't be main text). The stream is made from them
    where it is needed: kept beside them, it takes as much disk again."""

    def parse(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, html in batches_of(it, "html"):
            for start in range(0, batch.num_rows, 256):
                cut = [blocks(page) for page in html.slice(start, 256).to_pylist()]
                tokens, off = tokens_by_block([text for page in cut for text, _ in page])
                some, rows, at = batch.slice(start, 256), [], 0
                for page_id, url, host, page in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "host")), cut, strict=True):
                    s = tokens[off[at]:off[at + len(page)]]
                    n = np.diff(off[at:at + len(page) + 1]).astype("<i4")
                    n[[kind == DROP for _, kind in page]] *= -1
                    at += len(page)
                    texts = [text for text, _ in page]
                    rows.append((page_id, url, host, texts, xxhash.xxh3_64_intdigest(s.tobytes()) >> 1, len(s), n.tobytes(), sketch(text_tokens(s.astype(np.uint64), n))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], names)

    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds_of = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return written(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host")).mapInArrow(parse, PARSED), "pages")


def streamed(pages: DataFrame, columns: str, marks: Broadcast | None = None) -> DataFrame:
    """``columns`` of ``pages`` and stream, made from ``texts``; with ``marks``: of the rows whose place there is set, or more."""
    names = [c.split()[0] for c in columns.split(", ")]

    def emit(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if marks is not None:
                bits = np.unpackbits(np.frombuffer(marks.value, np.uint8)).astype(bool)
                batch = batch.filter(pa.array(bits[batch.column("mark").to_numpy(zero_copy_only=False)]))
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                tokens, off = tokens_by_block(some.column("texts").flatten())
                ends = np.r_[0, np.cumsum(pc.list_value_length(some.column("texts")).to_numpy(zero_copy_only=False))]
                stream = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer((off[ends] * 4).astype(np.int32).tobytes()), pa.py_buffer(tokens.tobytes())])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), stream], [*names, "stream"])

    return pages.select(*names, "texts", *(["mark"] if marks is not None else [])).mapInArrow(emit, f"{columns}, stream binary")


def main_blocks(texts: pa.ListArray, sizes: pa.Array) -> pa.ListArray:
    """Of the blocks of each page those that can be main text."""
    real = np.frombuffer(b"".join(sizes.to_pylist()), "<i4") > 0
    ends = np.r_[0, np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(real)][ends].astype(np.int32)), texts.flatten().filter(pa.array(real)))


def copies(table: DataFrame, min_run: int, share: float) -> DataFrame | None:
    """host, page, copy_of of pages that are copies of others, the same for all copies of one; None if there are none."""
    bands = table.select("host", "page", F.posexplode("bands").alias("band", "key"))
    least = bands.groupBy("host", "band", "key").agg(F.min("page").alias("other"), F.max("page").alias("last")).filter("other != last").drop("last")
    pairs = written(bands.join(least, ["host", "band", "key"]).filter("page != other").select("host", "page", "other").distinct(), "copy-pairs")
    if pairs.isEmpty():
        return None
    needed = pairs.select("host", "page").union(pairs.select("host", "other")).distinct()
    # rows of pages whose place isn't marked don't move
    mark = F.pmod(F.xxhash64("host", "page"), F.lit(MARKS)).cast("int")
    bits = np.zeros(MARKS, bool)
    bits[needed.select(mark.alias("mark")).distinct().toPandas()["mark"].to_numpy(np.int64)] = True  # MARKS rows at most
    marks = table.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())  # a fixed size
    streams = written(streamed(table.withColumn("mark", mark), "host string, page long, sizes binary", marks).join(needed, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]), "copy-streams")
    both = pairs.join(streams, ["host", "page"]).join(streams.select("host", F.col("page").alias("other"), F.col("stream").alias("stream2"), F.col("sizes").alias("sizes2")), ["host", "other"])

    def compare(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for stream, sizes, stream2, sizes2 in zip(*(batch.column(c).to_pylist() for c in ("stream", "sizes", "stream2", "sizes2")), strict=True):
                a = text_tokens(tokens_of(stream), np.frombuffer(sizes, "<i4"))
                b = text_tokens(tokens_of(stream2), np.frombuffer(sizes2, "<i4"))
                keep.append(bool(min(covered_by(a, run_hashes(b, min_run), min_run).mean(), covered_by(b, run_hashes(a, min_run), min_run).mean()) >= share))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("host", "page", "other")], ["host", "page", "other"])

    node = lambda c: F.xxhash64("host", c)
    same = written(both.select("host", "page", "other", "stream", "sizes", "stream2", "sizes2").mapInArrow(compare, "host string, page long, other long"), "copy-links")
    if same.isEmpty():
        return None
    label = components(same.select(node("page").alias("x"), node("other").alias("y")))
    named = same.select("host", "page").union(same.select("host", "other")).distinct().withColumn("x", node("page"))
    return written(named.join(label, "x").select("host", "page", F.col("label").alias("copy_of")), "copies")


def repeated_in(streams: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the streams in a row, to the depth of ``length``: per position the run's place
    in the order of all runs (equal runs have equal places; -1: the stream ends within), and the stream of each position."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    text = np.concatenate(streams) if len(streams) else np.empty(0, np.uint64)
    page = np.repeat(np.arange(len(streams)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # tokens up to the end of the stream
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        # the order by `depth` tokens and the order of what follows give the order by `depth + step`
        there = np.arange(len(text)) + step
        after = np.where(left > step, rank[np.minimum(there, len(text) - 1)] + 1, 0)
        rank = np.unique(rank * (len(text) + 1) + after, return_inverse=True)[1]
        depth += step
    whole = np.repeat(sizes, sizes)
    is_run = (left >= length) | ((whole < length) & (left == whole))
    return np.where(is_run, rank, -1), page


def cells_of(counts: bytes) -> np.ndarray:
    """A row of a sketch, compressed as most of its counts are small."""
    return np.frombuffer(pa.decompress(counts, 4 * CELLS, "zstd"), "<u4")


def added(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sum of the counts of the rows of each key; rows of a key stream through one task, a row at a time."""

    def add(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in it for r in zip(*(batch.column(c).to_pylist() for c in (*keys, "counts")), strict=True))
        for key, group in groupby(rows, key=lambda r: r[:-1]):
            total = np.zeros(CELLS, np.uint32)
            for *_, counts in group:
                own = cells_of(counts)
                total = np.where(total > ~own, ~np.uint32(0), total + own)  # full, not over
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string() if isinstance(k, str) else pa.int32()) for k in key] + [pa.array([pa.compress(total, "zstd", asbytes=True)], pa.binary())], [*keys, "counts"])

    kinds = ", ".join(f"{k} {'string' if k == 'host' else 'int'}" for k in keys)
    return sketches.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, f"{kinds}, counts binary")


def enough(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of a host's sketch: a bit a place, whether its count reaches what the host needs."""
    for batch in it:
        bits = [np.packbits(cells_of(c) >= need).tobytes() for c, need in zip(batch.column("counts").to_pylist(), batch.column("need").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shards"), batch.column("chunk"), pa.array(bits, pa.binary())], ["host", "shards", "chunk", "often"])


def cut_pages(table: DataFrame, min_run: int = MIN_RUN, shard_tokens: int = SHARD_TOKENS, min_pages: int = MIN_PAGES, share: float = COPY) -> DataFrame:
    """host, page, cuts: stretches of texts that boilerplate runs cover, as (block, from, to) in a row."""
    streams = table.filter("n_stream > 0").select("host", "page", "n_stream", "texts", "sizes")
    same = copies(table, min_run, share)
    streams = streams.withColumn("copy_of", F.lit(None).cast("long")) if same is None else streams.join(same, ["host", "page"], "left")
    streams = streams.withColumn("cluster", F.coalesce("copy_of", F.xxhash64("host", "page")))
    hosts = streams.groupBy("host").agg(F.ceil(F.sum("n_stream") / shard_tokens).cast("int").alias("shards"),
                                        F.greatest(F.lit(min_pages), F.ceil(F.sqrt(F.count_distinct("cluster")) / 2)).cast("int").alias("need"))
    hosts = written(hosts, "hosts")
    dealt = (streams.select("host", "page", "texts", "sizes", "cluster").join(hosts, "host")
             .withColumn("shard", F.pmod("page", "shards").cast("int")))
    own_turn = F.pmod(F.xxhash64("host", "shard"), F.lit(TURNS))

    def sort_suffixes(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("host", "shard", "shards", "need", "page", "cluster", "sizes", "stream")

        def rows():
            for batch in it:
                own = [batch.column(c) for c in columns]
                for x in zip(*(c.to_pylist() for c in own[:-1]), own[-1], strict=True):
                    yield x

        for (host, shard, shards, need), group in groupby(rows(), key=lambda x: x[:4]):
            pages, clusters, sizes, streams = [], [], [], []
            for *_, page, cluster, blocks_, stream in group:
                if not pages or page != pages[-1]:  # rows with the same stream are one page
                    pages.append(page)
                    clusters.append(cluster)
                    sizes.append(np.frombuffer(blocks_, "<i4"))
                    streams.append(tokens_of(stream.as_buffer()))
            if shards == 1 and len(set(clusters)) < need:
                continue
            rank, of = repeated_in(streams, min_run)
            kinds, number = np.unique(np.array(clusters, np.int64), return_inverse=True)
            at = np.flatnonzero(rank >= 0)
            place = rank[at] * len(kinds) + number[of[at]]
            by = np.argsort(place)
            order = at[by[np.r_[True, np.diff(place[by]) != 0]]]  # a place for each run and cluster
            if shards == 1:
                begin = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0])
                lead = order[begin[np.diff(np.r_[begin, len(order)]) >= need]]
                edges = np.cumsum([0] + [len(x) for x in streams])
                often = np.zeros(len(rank) + 1, bool)
                often[rank[lead]] = True
                hit = often[rank]  # the last place is that of -1
                cut = [cuts_of(spread(hit[a:a + max(1, b - a - min_run + 1)], b - a, min_run), x, min_run) for a, b, x in zip(edges, edges[1:], sizes, strict=False)]
                some = [i for i, c in enumerate(cut) if c]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(some), pa.string()), pa.array([pages[i] for i in some], pa.int64()), pa.array([cut[i] for i in some], pa.binary()),
                                                  *(pa.nulls(len(some), t) for t in (pa.int32(), pa.int32(), pa.binary()))], names)
                continue
            hashes = np.zeros(len(rank), np.uint64)
            hashes[at] = np.concatenate([run_hashes(x, min_run) for x in streams])
            counts = np.bincount(slots_of(hashes[order]), minlength=SLOTS).astype("<u4").reshape(-1, CELLS)
            for chunk in np.flatnonzero(counts.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([chunk], pa.int32()),
                                                  pa.array([shard % (math.isqrt(shards) + 1)], pa.int32()), pa.array([pa.compress(counts[chunk], "zstd", asbytes=True)], pa.binary())], names)

    names = ["host", "page", "cuts", "chunk", "salt", "counts"]
    parts = [written(streamed(dealt.filter(own_turn == k), "host string, shard int, shards int, need int, page long, cluster long, sizes binary").repartition("host", "shard").sortWithinPartitions("host", "shard", "page")
                     .mapInArrow(sort_suffixes, "host string, page long, cuts binary, chunk int, salt int, counts binary"), f"runs-{k}") for k in range(TURNS)]
    found = reduce(DataFrame.unionByName, parts)
    settled = written(found.filter("chunk IS NULL").select("host", "page", "cuts"), "settled")
    large = hosts.filter("shards > 1")
    if large.isEmpty():
        erase(*parts)
        return settled
    sketches = found.filter("chunk IS NOT NULL").select("host", "chunk", "salt", "counts")
    asked = written(added(added(sketches, "host", "chunk", "salt"), "host", "chunk").join(large, "host").mapInArrow(enough, "host string, shards int, chunk int, often binary"), "asked")
    erase(*parts)

    def places(pages: pa.Table, slots: pa.Table) -> pa.Table:
        """Of each page of a shard: where the runs that are asked for begin."""
        often = np.zeros((SLOTS // CELLS, CELLS), bool)
        for chunk, bits in zip(slots.column("chunk").to_pylist(), slots.column("often").to_pylist(), strict=True):
            often[chunk] = np.unpackbits(np.frombuffer(bits, np.uint8))
        often, out = often.reshape(-1), {}
        for host, page, cluster, stream, sizes in zip(*(pages.column(c).to_pylist() for c in ("host", "page", "cluster", "stream", "sizes")), strict=True):
            if page not in out:
                h = run_hashes(tokens_of(stream), min_run)
                at = np.flatnonzero(often[slots_of(h)])
                out[page] = (host, page, cluster, sizes, at, h[at].view(np.int64))
        rows = [r for r in out.values() if len(r[4])]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["host", "page", "cluster", "sizes", "at", "run"])

    def cover(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for sizes, at in zip(*(batch.column(c).to_pylist() for c in ("sizes", "at")), strict=True):
                sizes = np.frombuffer(sizes, "<i4")
                hit = np.zeros(int(np.abs(sizes).sum()), bool)
                hit[at] = True
                out.append(cuts_of(spread(hit, len(hit), min_run), sizes, min_run))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(out, pa.binary())], ["host", "page", "cuts"])

    # the runs of hosts of several shards: their places in all shards, then their pages
    everywhere = asked.select("host", "chunk", "often", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    parts = [written(streamed(dealt.filter(own_turn == k).filter("shards > 1"), "host string, shard int, page long, cluster long, sizes binary").groupBy("host", "shard")
                     .cogroup(everywhere.filter(own_turn == k).groupBy("host", "shard"))
                     .applyInArrow(places, "host string, page long, cluster long, sizes binary, at array<int>, run array<long>"), f"run-places-{k}") for k in range(TURNS)]
    hits = reduce(DataFrame.unionByName, parts)
    repeated = (hits.select("host", "cluster", F.explode(F.array_distinct("run")).alias("run")).groupBy("host", "run").agg(F.count_distinct("cluster").alias("n"))
                .join(large, "host").filter("n >= need").select("host", "run"))
    placed = (hits.select("host", "page", F.explode(F.arrays_zip("at", "run")).alias("p")).select("host", "page", F.col("p.at").alias("at"), F.col("p.run").alias("run"))
              .join(written(repeated, "repeated-runs"), ["host", "run"]).groupBy("host", "page").agg(F.collect_list("at").alias("at"))
              .join(hits.select("host", "page", "sizes"), ["host", "page"]).mapInArrow(cover, "host string, page long, cuts binary"))
    return settled.unionByName(written(placed.filter(F.length("cuts") > 0), "cuts"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_run: int = MIN_RUN, shard_tokens: int = SHARD_TOKENS, min_pages: int = MIN_PAGES, share: float = COPY) -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate (blocks that lost words to repeated runs) of every page."""
    table = parsed(pages, id_col, url_col, html_col)
    cuts = cut_pages(table, min_run, shard_tokens, min_pages, share)

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            main = main_blocks(batch.column("texts"), batch.column("sizes"))
            text = pc.binary_join(main, "\n")  # pages without cuts stay as they are
            count = np.zeros(batch.num_rows, np.int64)
            at = np.flatnonzero(batch.column("cuts").is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                shorter = []
                for i, texts, gone in zip(at.tolist(), main.take(pa.array(at)).to_pylist(), batch.column("cuts").take(pa.array(at)).to_pylist(), strict=True):
                    spans = np.frombuffer(gone, "<i4").reshape(-1, 3).tolist()
                    words = {j: texts[j].split(" ") for j, _, _ in spans}
                    for j, a, b in reversed(spans):
                        del words[j][a:b]
                    shorter.append("\n".join(t for t in (" ".join(words[j]) if j in words else t for j, t in enumerate(texts)) if t))
                    count[i] = len(words)
                text = pc.replace_with_mask(text, batch.column("cuts").is_valid(), pa.array(shorter, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pc.utf8_length(text).cast(pa.int64()), pa.array(count)],
                                             ["page_id", "url", "text", "n_chars", "n_boilerplate"])

    own = table.select("page_id", "url", "host", "page", "texts", "sizes").join(cuts, ["host", "page"], "left")
    return own.select("page_id", "url", "texts", "sizes", "cuts").mapInArrow(cut, "page_id long, url string, text string, n_chars long, n_boilerplate long")
