"""Operator 10: token-id shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by doc_id (null first); every text (null: empty) is
encoded whole and ended with one end id. A partition writes shards of a bounded number of ids.
A shard is one row of a Parquet table:

    part, shard   where it stands in the order of doc_id
    payload       ids, little-endian unsigned 32-bit, document after document
    keys          the documents' keys in order of doc_id, 13 bytes each (KEY)
    index         n, buckets, seed (uint32), then a displacement (int32) a bucket, then per slot a
                  fingerprint (uint32) and the document's place in order (uint32)
    bounds        uint64: where each document's ids begin in the payload, and the end
    n_ids         ids in the payload

    first, last, n_last   its first and last doc_id, and how many rows of the last one its part holds up to here

In a shard a key is found in constant time: its bucket's displacement gives its slot, the slot's
fingerprint rejects keys that are not there, the slot's document gives the offsets, and the stored
key settles it. A shard's key is (doc_id or null, rows of that doc_id before it in its part).

The directory maps a document's key (doc_id or null, rows of that doc_id before it in the whole
table) to its part, its shard and its key there. It is a second table of perfect hashes, dealt over
rows of about SHARD_DOCS keys by a hash of the key, so that one doc_id with a third of all rows is
spread like any other. A lookup deals the asked keys the same way, probes one directory row for
each, and meets the shards with what was found.

Defined results. Null text: the end id alone. Null doc_id: first in order. Repeated rows: each has
its own place and key (equal ids are ordered by their text). Asked keys that aren't there: no row. Empty
table: no shards, no rows.
"""
from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skychan.llm.common import batches_of
from skychan.llm.tokens import WordEncoder, vocabulary_path
from skychan.session import work_path

END_ID = 2
KEY, KEY_BYTES = "<?qI", 13
SHARD_IDS, SHARD_DOCS = 1_000_000, 4096
#: Keys a bucket has on average.
BUCKET = 2
#: Displacements that are tried at once.
TRIES = 64
SHARDS = "part int, shard int, n_docs int, n_ids long, payload binary, keys binary, index binary, bounds binary, first long, last long, n_last long"
DIRECTORY = "bucket long, index binary"
FOUND = "doc_id long, nth long, part int, shard int, own long"
READ = "doc_id long, nth long, part int, shard int, inside long, ids binary"


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    """Per key: three 32-bit numbers and a fingerprint."""
    h = b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys)
    return np.frombuffer(h, "<u4").reshape(-1, 4).astype(np.uint64)


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys under displacements: another pseudo-random number for each displacement."""
    x = (h[..., 1] ^ (d * np.uint64(0x9E3779B97F4A7C15))) * (h[..., 2] | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def build_index(keys: list[bytes], values: np.ndarray | None = None) -> bytes:
    """A slot holds a key's fingerprint and its row of ``values`` (unsigned 32 bits; by default its place in ``keys``). Hash and displace: buckets of several keys, largest first, look for a displacement that puts all in free slots;
    buckets of one key take the free slots that are left (stored as -1 - slot)."""
    n = len(keys)
    n_buckets = max(1, -(-n // BUCKET))
    for seed in range(100):
        h = _hashes(keys, seed)
        bucket = (h[:, 0] % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=n_buckets)
        begin = np.cumsum(size) - size
        taken, shift, slot_of = np.zeros(n, bool), np.zeros(n_buckets, np.int32), np.empty(n, np.int64)
        good = True
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own = order[begin[b]:begin[b] + size[b]]
            for base in range(0, 64 * n + 4096, TRIES):
                d = np.arange(base, base + TRIES, dtype=np.uint64)
                s = np.sort(_slot(h[own][None, :, :], d[:, None], n), axis=1)
                fits = ~taken[s].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    d = d[int(fits.argmax())]
                    break
            else:
                good = False
                break
            s = _slot(h[own], np.array([d], np.uint64), n)
            taken[s], slot_of[own], shift[b] = True, s, d
        if not good:
            continue
        single = np.flatnonzero(size == 1)
        free = np.flatnonzero(~taken)[:len(single)]
        shift[single], slot_of[order[begin[single]]] = -1 - free, free
        values = np.arange(n).reshape(-1, 1) if values is None else values
        slots = np.empty((n, 1 + values.shape[1]), "<u4")
        slots[slot_of, 0], slots[slot_of, 1:] = h[:, 3], values
        return struct.pack("<III", n, n_buckets, seed) + shift.astype("<i4").tobytes() + slots.tobytes()
    raise ValueError("equal keys can't be told apart")


class PerfectHash:
    """What ``build_index`` made."""

    def __init__(self, index: bytes, width: int = 1):
        self.n, self.n_buckets, self.seed = struct.unpack_from("<III", index)
        self.shift = np.frombuffer(index, "<i4", self.n_buckets, 12)
        self.slots = np.frombuffer(index, "<u4", (1 + width) * self.n, 12 + 4 * self.n_buckets).reshape(-1, 1 + width)

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there (but for one in 2^32 of the others), and the values of their slots."""
        h = _hashes(keys, self.seed)
        shift = self.shift[(h[:, 0] % np.uint64(self.n_buckets)).astype(np.int64)].astype(np.int64)
        slot = np.where(shift < 0, -1 - shift, _slot(h, np.maximum(shift, 0).astype(np.uint64), self.n))
        found = self.slots[slot]
        return found[:, 0] == h[:, 3], found[:, 1:].astype(np.int64)


class ShardReader(PerfectHash):
    """Keyed access to one shard."""

    def __init__(self, payload: bytes, index: bytes, bounds: bytes):
        super().__init__(index)
        self.bounds = np.frombuffer(bounds, "<u8")
        self.ids = np.frombuffer(payload, "<u4")

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The documents' places in the shard, -1 for keys that are not there (but for one in 2^32)."""
        if not keys:
            return np.empty(0, np.int64)
        there, place = self.find(keys)
        return np.where(there, place[:, 0], -1)

    def ids_of(self, place: int) -> np.ndarray:
        return self.ids[int(self.bounds[place]):int(self.bounds[place + 1])]


def _key(doc_id: int | None, number: int) -> bytes:
    return struct.pack(KEY, doc_id is not None, doc_id or 0, number)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Write the shards of ``docs`` to ``path``."""
    vocabulary = vocabulary or vocabulary_path()

    def shards(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = WordEncoder.of(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[bytes] = []
        bounds = [0]
        first, last, before = None, object(), 0

        def row() -> pa.RecordBatch:
            one = [part, shard, len(keys), bounds[-1], np.concatenate(ids).astype("<u4").tobytes(), b"".join(keys), build_index(keys), np.array(bounds, "<u8").tobytes(),
                   first, last, before + 1]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 4 + [pa.int64()] * 3, strict=True)],
                                              ["part", "shard", "n_docs", "n_ids", "payload", "keys", "index", "bounds", "first", "last", "n_last"])

        for batch, texts in batches_of(it, limit=6_000_000):
            flat, off = encoder.encode(texts)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.append(flat[off[i]:off[i + 1]], np.uint32(end_id))
                if keys and (bounds[-1] + len(own) > shard_ids or len(keys) >= shard_docs):
                    yield row()
                    shard, ids, keys, bounds = shard + 1, [], [], [0]
                last, before = (doc_id, before + 1) if doc_id == last else (doc_id, 0)
                first = first if keys else doc_id
                ids.append(own)
                keys.append(_key(doc_id, before))
                bounds.append(bounds[-1] + len(own))
        if keys:
            yield row()

    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie"))
    ordered.mapInArrow(shards, SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, first: ids of all shards before. Reads only the counts; a task sees a row a partition at most."""
    sizes = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.join(parts, "part")
            .select("part", "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first")))


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, edge, before: of the doc_id ``edge`` that a part begins with, the rows that the parts before it hold (as parts are ordered,
    it is the last doc_id of those). A row a part; a task sees the parts that one doc_id ends at most."""
    parts = (spark.read.schema(SHARDS).parquet(path).groupBy("part")
             .agg(F.min_by(F.struct("first"), "shard").alias("a"), F.max_by(F.struct("last", "n_last"), "shard").alias("b")))
    each = parts.select("part", F.inline(F.array(F.struct(F.col("a.first").alias("edge"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("begins")),
                                                 F.struct(F.col("b.last").alias("edge"), F.col("b.n_last").alias("n"), F.lit(False).alias("begins")))))
    before = Window.partitionBy("edge").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("begins").select("part", "edge", "before")


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(n_buckets))


def write_directory(spark: SparkSession, path: str, directory: str, keys_a_row: int = SHARD_DOCS) -> None:
    """Write the directory of the shards at ``path``: a row for about ``keys_a_row`` keys. Reads the shards' keys, not their payload."""

    def keys_of(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, shard, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                is_set, ids, own = zip(*struct.iter_unpack(KEY, keys), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d if s else None for s, d in zip(is_set, ids, strict=True)], pa.int64()), pa.array([part] * len(ids), pa.int32()),
                     pa.array([shard] * len(ids), pa.int32()), pa.array(own, pa.int64())], ["doc_id", "part", "shard", "own"])

    def build(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_id, nth, *values = rows.values.flatten()
                index = build_index([_key(d, n) for d, n in zip(doc_id.to_pylist(), nth.to_pylist(), strict=True)], np.stack([v.to_numpy() for v in values], 1))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([index], pa.binary())], ["bucket", "index"])

    shards = spark.read.schema(SHARDS).parquet(path)
    n_docs = shards.agg(F.sum("n_docs")).first()[0] or 0
    keys = shards.select("part", "shard", "keys").mapInArrow(keys_of, "doc_id long, part int, shard int, own long")
    edges = part_offsets(spark, path).withColumnRenamed("part", "e_part")
    keys = keys.join(edges, keys["part"] == edges["e_part"])  # a row a part on this side
    nth = F.col("own") + F.when(F.col("doc_id").eqNullSafe(F.col("edge")), F.col("before")).otherwise(0)
    keys = keys.withColumn("nth", nth)
    rows = keys.groupBy(_bucket(max(1, -(-n_docs // keys_a_row))).alias("bucket")).agg(F.collect_list(F.struct("doc_id", "nth", "part", "shard", "own")).alias("rows"))
    rows.mapInArrow(build, DIRECTORY).write.mode("overwrite").parquet(directory)


def lookup(spark: SparkSession, path: str, directory: str, asked: DataFrame, keys_a_row: int = SHARD_DOCS) -> DataFrame:
    """The ids of the documents ``asked``: a column doc_id, and optionally ``n``, for the first n rows of that id (default: one; asking twice
    is asking once). One row per document that is there, see READ; ``ids`` are little-endian unsigned 32-bit numbers."""

    def probe(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for index, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_id, nth = rows.values.flatten()
                there, values = PerfectHash(index, 3).find([_key(d, n) for d, n in zip(doc_id.to_pylist(), nth.to_pylist(), strict=True)])
                found, values = pa.array(there), values[there]
                yield pa.RecordBatch.from_arrays([doc_id.filter(found), nth.filter(found), pa.array(values[:, 0], pa.int32()), pa.array(values[:, 1], pa.int32()),
                                                  pa.array(values[:, 2])], ["doc_id", "nth", "part", "shard", "own"])

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):  # a shard at a time
                part, shard, payload, keys, index, bounds, rows = (c[i] for c in batch.columns)
                part, shard, keys = part.as_py(), shard.as_py(), keys.as_py()
                reader = ShardReader(payload.as_buffer(), index.as_py(), bounds.as_py())
                doc_id, nth, own = rows.values.flatten()
                want = [_key(d, n) for d, n in zip(doc_id.to_pylist(), own.to_pylist(), strict=True)]
                places = reader.places(want)
                good = np.array([p >= 0 and keys[p * KEY_BYTES:(p + 1) * KEY_BYTES] == k for p, k in zip(places.tolist(), want, strict=True)], bool)
                places = places[good]
                yield pa.RecordBatch.from_arrays(
                    [doc_id.filter(pa.array(good)), nth.filter(pa.array(good)), pa.array([part] * len(places), pa.int32()), pa.array([shard] * len(places), pa.int32()),
                     pa.array(reader.bounds[places].astype(np.int64)), pa.array([reader.ids_of(int(p)).tobytes() for p in places], pa.binary())],
                    ["doc_id", "nth", "part", "shard", "inside", "ids"])

    shards, table = spark.read.schema(SHARDS).parquet(path), spark.read.schema(DIRECTORY).parquet(directory)
    n_docs = shards.agg(F.sum("n_docs")).first()[0] or 0
    n_buckets = max(1, -(-n_docs // keys_a_row))
    many = F.col("n").cast("long") if "n" in asked.columns else F.lit(1).cast("long")
    wanted = asked.select(F.col("doc_id").cast("long").alias("doc_id"), many.alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")).where("n > 0")
    # the rows of an id in runs of keys_a_row, so that an id with many rows is many tasks' work
    runs = wanted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / keys_a_row))).alias("run"))
    low = F.col("run") * keys_a_row
    keys = runs.repartition("doc_id", "run").select("doc_id", F.explode(F.sequence(low, F.least(low + keys_a_row, F.col("n")) - 1)).alias("nth"))
    # more keys than documents are asked for: a directory row is met in as many pieces
    n_asked = wanted.agg(F.sum("n")).first()[0] or 0
    pieces = max(1, -(-n_asked // max(1, n_docs)))
    dealt = (keys.groupBy(_bucket(n_buckets).alias("bucket"), F.pmod(F.xxhash64(F.lit(1), "nth", "doc_id"), F.lit(pieces)).alias("piece"))
             .agg(F.collect_list(F.struct("doc_id", "nth")).alias("rows")))
    found = dealt.join(table, "bucket").select("index", "rows").mapInArrow(probe, FOUND)
    per_shard = found.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "nth", "own")).alias("rows"))  # a shard's documents at most, but for false finds
    return (shards.select("part", "shard", "payload", "keys", "index", "bounds").join(per_shard, ["part", "shard"])
            .select("part", "shard", "payload", "keys", "index", "bounds", "rows").mapInArrow(read, READ))


def indexed_ids(docs: DataFrame, id_col: str = "doc_id", shard_docs: int = SHARD_DOCS, **options) -> DataFrame:
    """Write shards and directory to the work folder, then look every document up by its key. Per document, from the files: doc_id,
    start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path, directory = work_path(spark, "id-shards"), work_path(spark, "id-directory")
    write_shards(docs, path, id_col=id_col, shard_docs=shard_docs, **options)
    write_directory(spark, path, directory, shard_docs)
    asked = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    found = lookup(spark, path, directory, asked, shard_docs)
    digests = found.select("doc_id", "part", "shard", "inside", F.floor(F.length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return (digests.join(shard_starts(spark, path), ["part", "shard"])
            .select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
