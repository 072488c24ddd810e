"""Operator 6: quality classifier on random-indexing word vectors.

Random indexing: each word bucket has a sparse random index vector (two signed ones, given by its hash).
A word's vector is the sum of the index vectors of the words within WINDOW places of its
occurrences, over the whole corpus. The same is done for word shapes (letters, digits and signs,
runs shortened), so that words never seen before have a vector too. Words are hashed to a fixed
number of buckets, so the vectors are a table of fixed size at any corpus size; each task sums its own,
Spark adds them up.

A document's input is the mean of its words' vectors, of its shapes' vectors, and a few figures about
its words (how many, how many different, their length). A network with one hidden layer is trained
in numpy on at most ``max_train`` labelled documents (those with the smallest hash of their id), which
is the only bound; vectors and scores cover every document whole. A tenth of the sample isn't
trained on: it stops the training and sets the temperature that calibrates the probabilities.

Never inputs: labels, lang, source, doc_id. Held-out documents (crc32 of the id as text mod 5 = 0)
are in the corpus statistics, but their labels are never read.

Defined results. Null or empty text: a document without words, scored from zero vectors. Null
doc_id: held out. Repeated rows: each scored alike. Null labels: none. Without labels of both
kinds: everything scores the share of label 1, or 0.5. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import batches_of, words_of

DIM = 32
WORD_BUCKETS, SHAPE_BUCKETS = 4096, 1024
WINDOW = 2
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: A document is predicted 1 from this score.
CUT = 0.3
EXTRA = 6


def _buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape bucket of each distinct word. The word bucket ignores case and signs around it."""
    core = pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[^\p{Lu}\pN\pP\pS]+", "a"), (r"\pN+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    of = lambda a, n: (pd.util.hash_array(a.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(n)).astype(np.int64)
    return of(core, WORD_BUCKETS), of(shape, SHAPE_BUCKETS)


def _index(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two ones in each bucket's index vector."""
    g = np.random.default_rng(salt)
    return g.integers(0, DIM, (n, 2)), g.choice([-1.0, 1.0], (n, 2))


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its word bucket, shape bucket, length and number in the dictionary; where texts begin."""
    words, off = words_of(texts, lower=False)
    coded = pc.dictionary_encode(words)
    at = coded.indices.to_numpy(zero_copy_only=False)
    w, s = _buckets(coded.dictionary)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    return w[at], s[at], length[at], at, off


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of all word buckets, then of all shape buckets, unit length. Sums over every word of every text."""
    sizes = (WORD_BUCKETS, SHAPE_BUCKETS)

    def add_up(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n * DIM) for n in sizes]
        index = [_index(n, 11 + i) for i, n in enumerate(sizes)]
        seen = False
        for _, texts in batches_of(it):
            seen = True
            w, s, _, _, off = _coded(texts)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            for k in range(1, WINDOW + 1):
                near = doc[k:] == doc[:-k]
                for i, b in enumerate((w, s)):
                    left, right = b[:-k][near], b[k:][near]
                    place, sign = index[i]
                    for a, c in ((left, right), (right, left)):
                        for j in (0, 1):
                            total[i] += np.bincount(a * DIM + place[c, j], sign[c, j], sizes[i] * DIM)
        if seen:
            x = np.concatenate(total).reshape(-1, DIM)
            kept = np.flatnonzero(x.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), *(pa.array(x[kept, j]) for j in range(DIM))], ["bucket", *(f"d{j}" for j in range(DIM))])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(add_up, "bucket int, " + ", ".join(f"d{j} double" for j in range(DIM)))
    rows = sums.groupBy("bucket").agg(*(F.sum(f"d{j}").alias(f"d{j}") for j in range(DIM))).toPandas()  # a fixed number of rows at most
    out = np.zeros((sum(sizes), DIM))
    out[rows["bucket"].to_numpy()] = rows.drop(columns="bucket").to_numpy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row a text: means of word and shape vectors, then figures about its words."""
    w, s, length, at, off = _coded(texts)
    n = np.diff(off)
    out = np.zeros((len(n), 2 * DIM + EXTRA), np.float32)
    has = np.flatnonzero(n > 0)
    if not len(has):
        return out
    start, count = off[:-1][has], n[has].astype(np.float32)
    for i, b in enumerate((w, s + WORD_BUCKETS)):
        for j in range(DIM):
            out[has, i * DIM + j] = np.add.reduceat(vectors[:, j][b], start) / count
    doc = np.repeat(np.arange(len(n)), n)
    different = np.bincount(np.unique(doc.astype(np.int64) * (int(at.max()) + 1) + at) // (int(at.max()) + 1), minlength=len(n))[has]
    mean = np.add.reduceat(length, start) / count
    square = np.add.reduceat(length.astype(np.float64) ** 2, start) / count
    figures = (np.log1p(count) / 5, different / count, np.log1p(different) / 5, mean / 8, np.sqrt(np.maximum(square - mean ** 2, 0)) / 4, np.ones_like(count))
    out[has, 2 * DIM:] = np.stack(figures, axis=1)
    return out


class Network:
    """Inputs scaled, one hidden layer of tanh units, one logit, divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        g = np.random.default_rng(seed)
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.dev
        order = g.permutation(len(x))
        held = order[:max(1, len(x) // 10)]
        own = order[len(held):] if len(x) > 20 else order
        p = [g.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        best, step = (np.inf, p), 0
        for _ in range(EPOCHS):
            g.shuffle(own)
            for i in range(0, len(own), 128):
                b = own[i:i + 128]
                h = np.tanh(x[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[b]) / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for a, m, v, grad in zip(p, first, second, (x[b].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)), strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    a -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            loss = self._loss(self._logit(x[held], p), y[held])
            if loss < best[0]:
                best = loss, [a.copy() for a in p]
        self.p = best[1]
        logit = self._logit(x[held], self.p)
        temperatures = np.geomspace(0.25, 8, 61)
        self.temperature = float(min(temperatures, key=lambda t: self._loss(logit / t, y[held])))

    @staticmethod
    def _logit(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
        return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self._logit((x - self.mean) / self.dev, self.p) / self.temperature))


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5) == 0


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN):
    """Word vectors of the corpus and a network, as a function from texts to scores for the tasks."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))  # a fixed size

    def pooled(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.astype("<f4").tobytes() for r in pool(texts, vectors.value)], pa.binary())], ["doc_id", "label", "x"])

    known = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label_col).cast("double").alias("label"))
             .filter("l_id IS NOT NULL AND label IS NOT NULL").filter(~held_out("l_id")).groupBy("l_id").agg(F.max("label").alias("label")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ids first: the sample is chosen among narrow rows, then its texts become vectors; max_train rows at most are broadcast and reach the driver
    ids = known.join(d.select("doc_id"), F.col("l_id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("l_id"), "l_id").limit(max_train)
    sample = (d.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text").mapInArrow(pooled, "doc_id long, label double, x binary")
              .groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").limit(max_train).collect())
    x = np.array([np.frombuffer(r.x, "<f4") for r in sample], np.float64).reshape(len(sample), 2 * DIM + EXTRA)
    model = Network(x, np.array([float(r.label > 0) for r in sample]))
    return lambda texts: model.scores(pool(texts, vectors.value).astype(np.float64))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    score = fitted(docs, labels, id_col, text_col, **options)

    def scores(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(texts))], ["doc_id", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scores, "doc_id long, score double")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """The rows of ``docs`` that are predicted good, where they are: nothing is shuffled."""
    score = fitted(docs, labels, id_col, text_col, **options)

    def keep(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it, text_col):
            yield batch.filter(pa.array(score(texts) >= cut))

    return docs.mapInArrow(keep, docs.schema)
