"""Operator 5: gated recurrent language model with a class-factored output.

Corpus pass. Texts are cut into blocks of about BLOCK_BYTES; each block's words are numbered by the block's own
dictionary, so that after one pass over the texts only numbers move. The blocks' dictionaries,
with counts from training documents, are summed over the corpus by word: counts, N and V cover every
training document, and grow with it.

Model. The most frequent words (and the end) are modelled one by one: their order by
co-occurrence, halved again and again along the principal direction, makes classes of MEMBERS words. All
other words fall into tail classes by their letters (nearest letter-pair profile of a stretch of that
order). A gated recurrent unit reads words; a softmax over classes, then a softmax over the
class's members, gives the next word's probability; within a tail class the probability is
(c + 0.5) / (n + 0.5 (v + 1)) from the corpus counts of the class, with one place for words not seen.

Training: truncated backpropagation in numpy on all training documents, in EPOCHS times PARTS rounds. A round
takes the documents of one part (by hash of doc_id): each task starts from the broadcast weights, learns from its own documents
and gives its weights; Spark averages them by words learned from, so that only weights, of a fixed size, reach the driver.
Within a task: parallel streams of documents, windows of STEPS words, the state carried from window to window and
reset where a document begins. The order of the words comes from co-occurrence sums over all training documents.

Scoring: a block meets its dictionary's counts and classes (both bounded by the block). Documents run
side by side, sorted by length, window after window with the state carried, to the end of the longest,
so the score is the log10 likelihood of the complete text and its end.

Defined results. Null and empty text: the end alone. Null doc_id: crc32 of an empty text, so not
held out. Repeated rows: each scored alike. No training documents: base and score 0 (probability 1). Empty
table: no rows. Texts are read whole; a text longer than a block is a block.
"""
from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychan.llm.common import batches_of, plain_texts, words_of, written

BLOCK_BYTES = 16_000_000
FREQUENT, MEMBERS, TAILS = 1024, 32, 8
UNITS, STEPS, STREAMS = 16, 32, 64
EPOCHS, PARTS, RATE = 2, 4, 0.01
#: Pieces in which tables of numbers are summed.
CHUNKS = 64
PAIRS = 4096
#: The end of a text, as a word.
END = ""
#: Documents that run side by side.
ABREAST = 2048
CODED = "block long, idx int, word string, c long, doc_id long, held_out boolean, n long, ids binary"


def coded_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Table of two kinds of rows: a word of a block's dictionary (idx, word, c: its count in training documents), or a document (doc_id, ids)."""
    names = [c.split()[0] for c in CODED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def emit(block: int, ids: list, held: list[bool], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        words, off = words_of(texts)
        coded = pc.dictionary_encode(words)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1  # 0 is the end
        n = np.diff(off)
        train = ~np.array(held, bool)
        count = np.bincount(at[np.repeat(train, n)], minlength=len(coded.dictionary) + 1)
        count[0] = train.sum()
        spelled = pa.concat_arrays([pa.array([END], pa.string()), coded.dictionary.cast(pa.string())])
        for i in range(0, len(spelled), 50_000):
            k = len(spelled[i:i + 50_000])
            empty = [pa.nulls(k, t) for t in kinds[4:]]
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, kinds[0]), pa.array(np.arange(i, i + k, dtype=np.int32)), spelled[i:i + k], pa.array(count[i:i + k]), *empty], names)
        at = at.astype("<i4")
        for i in range(0, len(ids), 500):
            k = len(ids[i:i + 500])
            own = [at[off[j]:off[j + 1]].tobytes() for j in range(i, i + k)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, kinds[0]), *(pa.nulls(k, t) for t in kinds[1:4]), pa.array(ids[i:i + k], kinds[4]), pa.array(held[i:i + k], kinds[5]), pa.array(n[i:i + k] + 1), pa.array(own, kinds[7])], names)

    def code(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in it:
            all_texts = plain_texts(batch.column("text"))
            length = pc.binary_length(all_texts).to_numpy(zero_copy_only=False)
            begin = 0
            for i, own in enumerate(length):
                if size and size + own > block_bytes:
                    texts.append(all_texts.slice(begin, i - begin))
                    ids += batch.column("doc_id").slice(begin, i - begin).to_pylist()
                    held += batch.column("held_out").slice(begin, i - begin).to_pylist()
                    yield from emit(block, ids, held, pa.concat_arrays(texts))
                    block, ids, held, texts, size, begin = block + 1, [], [], [], 0, i
                size += int(own)
            texts.append(all_texts.slice(begin))
            ids += batch.column("doc_id").slice(begin).to_pylist()
            held += batch.column("held_out").slice(begin).to_pylist()
        if ids:
            yield from emit(block, ids, held, pa.concat_arrays(texts))

    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc % 5 == 1).alias("held_out"), F.col(text_col).alias("text"))
    return written(d.mapInArrow(code, CODED), "coded-blocks")


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text and part (of PARTS) of the training documents."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.filter(F.crc32(key) % 5 != 1).select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part"))


def summed(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Sum of the vectors that tasks give in CHUNKS pieces (chunk, n, v), and of their n."""

    def add(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in it:
            for chunk, n, v in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "v")), strict=True):
                own = total.setdefault(chunk, [0, 0.0])
                own[0], own[1] = own[0] + n, own[1] + np.frombuffer(v, "<f8")
        for chunk, (n, v) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["chunk", "n", "v"])

    got = sorted(rows.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, n long, v binary").collect(), key=lambda r: r.chunk)  # a fixed size
    return (np.concatenate([np.frombuffer(r.v, "<f8") for r in got]), got[0].n) if got else (np.empty(0), 0)


def pieces(v: np.ndarray, n: int) -> pa.RecordBatch:
    parts = np.array_split(v.astype("<f8"), CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([n] * CHUNKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n", "v"])


def co_occurrence(texts: DataFrame, words: list[str]) -> np.ndarray:
    """Words by words: sum over all documents of log(1 + count) of the one times that of the other."""
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # a fixed size
    k = len(words)

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch, own in batches_of(it):
            flat, off = words_of(own)
            coded = pc.dictionary_encode(flat)
            known = np.array([shared.value.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            mine = known[coded.indices.to_numpy(zero_copy_only=False)]
            n += batch.num_rows
            for i in range(0, batch.num_rows, 256):
                docs = min(256, batch.num_rows - i)
                at = mine[off[i]:off[i + docs]]
                of = np.repeat(np.arange(docs), np.diff(off[i:i + docs + 1]))
                a = np.log1p(np.bincount((of * k + at)[at >= 0], minlength=docs * k).reshape(docs, k)).astype(np.float32)
                total += a.T @ a
        if n:
            yield pieces(total.reshape(-1), n)

    total, _ = summed(texts.select("text").mapInArrow(count, "chunk int, n long, v binary"))
    return total.reshape(k, k) if len(total) else np.zeros((k, k))


def word_order(together: np.ndarray) -> np.ndarray:
    """Words (by their co-occurrence) in an order in which near places are words of the same documents."""
    norm = np.maximum(np.sqrt(np.diag(together)), 1e-9)
    value, vector = np.linalg.eigh(together / norm[:, None] / norm)
    x = vector[:, -8:] * np.sqrt(np.maximum(value[-8:], 0))

    def halve(ids: np.ndarray) -> list[int]:
        if len(ids) <= MEMBERS:
            return ids.tolist()
        own = x[ids] - x[ids].mean(axis=0)
        direction = np.linalg.svd(own, full_matrices=False)[2][0]
        direction = direction * np.sign(direction[np.abs(direction).argmax()])
        ids = ids[np.argsort(own @ direction, kind="stable")]
        half = -(-len(ids) // (2 * MEMBERS)) * MEMBERS
        return halve(ids[:half]) + halve(ids[half:])

    return np.array(halve(np.arange(len(together))), np.int64)


def letter_pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of bytes of each word with its ends, in a row, and where each word's begin."""
    data = np.frombuffer(b"\n" + b"".join(w.encode() + b"\n" for w in words.to_pylist()), np.uint8).astype(np.int64)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return (data[:-1] * 257 + data[1:]) * 7919 % PAIRS, np.cumsum(length) - length


class Model:
    """words: the modelled words, class by class. Numbers of words: place in ``words``, then the tail classes."""

    def __init__(self, words: list[str], tail_scores: np.ndarray, seed: int = 3):
        self.words, self.tail_scores = words, tail_scores
        self.number = {w: i for i, w in enumerate(words)}
        self.k = len(words)
        self.heads = -(-self.k // MEMBERS)
        self.classes = self.heads + TAILS
        g = np.random.default_rng(seed)
        f = np.float32
        self.p = {"in": g.normal(0, 0.1, (self.k + TAILS, 3 * UNITS)).astype(f), "u": g.normal(0, 1 / np.sqrt(UNITS), (UNITS, 3 * UNITS)).astype(f),
                  "wc": np.zeros((UNITS, self.classes), f), "bc": np.zeros(self.classes, f),
                  "wm": np.zeros((self.heads, UNITS, MEMBERS), f), "bm": np.zeros((self.heads, MEMBERS), f)}
        if self.k % MEMBERS:
            self.p["bm"][-1, self.k % MEMBERS:] = -1e9
        self.tail_n = np.zeros(TAILS)
        self.tail_v = np.zeros(TAILS)

    def class_of(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < self.k, number // MEMBERS, number - self.k + self.heads)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words."""
        if not len(words):
            return np.empty(0, np.int64)
        pairs, begin = letter_pairs(words)
        tail = np.add.reduceat(self.tail_scores[pairs], begin, axis=0).argmax(axis=1) + self.k
        get = self.number.get
        known = np.fromiter((get(w, -1) for w in words.to_pylist()), np.int64, len(words))
        return np.where(known >= 0, known, tail)

    def step(self, number: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        x, y = self.p["in"][number], h @ self.p["u"]
        gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :2 * UNITS] + y[:, :2 * UNITS]))
        z, r = gates[:, :UNITS], gates[:, UNITS:]
        m = y[:, 2 * UNITS:]
        n = np.tanh(x[:, 2 * UNITS:] + r * m)
        return n + z * (h - n), (z, r, m, n)

    def log_probs(self, h: np.ndarray, number: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of class and member probability of each word after state ``h``; with ``grad``: adds the gradients, gives that of ``h``."""
        c = self.class_of(number)
        logits = h @ self.p["wc"]
        logits += self.p["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(c))
        out = logits[rows, c]
        e = np.exp(logits, out=logits)
        s = e.sum(axis=1, keepdims=True)
        out -= np.log(s[:, 0])
        back = None
        if grad is not None:
            e /= s
            e[rows, c] -= 1
            grad["wc"] += h.T @ e
            grad["bc"] += e.sum(axis=0)
            back = e @ self.p["wc"].T
        # words by class, so that each class's are a slice
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(self.heads + 1))
        order = order[:edges[-1]]
        sorted_h, member = h[order], number[order] % MEMBERS
        log_p = np.empty(len(order), out.dtype)
        sorted_back = None if grad is None else np.empty_like(sorted_h)
        for k in range(self.heads):
            own = slice(edges[k], edges[k + 1])
            n = edges[k + 1] - edges[k]
            if not n:
                continue
            x, j, i = sorted_h[own], member[own], np.arange(n)
            a = x @ self.p["wm"][k]
            a += self.p["bm"][k]
            a -= a.max(axis=1, keepdims=True)
            picked = a[i, j]
            e = np.exp(a, out=a)
            s = e.sum(axis=1, keepdims=True)
            log_p[own] = picked - np.log(s[:, 0])
            if grad is not None:
                e /= s
                e[i, j] -= 1
                grad["wm"][k] += x.T @ e
                grad["bm"][k] += e.sum(axis=0)
                np.matmul(e, self.p["wm"][k].T, out=sorted_back[own])
        out[order] += log_p
        if grad is not None:
            back[order] += sorted_back
        return out, back

    def start(self, counts: np.ndarray) -> None:
        """Biases from the counts of all numbers in training documents."""
        every = counts + 0.5
        share = np.bincount(self.class_of(np.arange(self.k + TAILS)), every, self.classes)
        self.p["bc"] = np.log(share / share.sum()).astype(np.float32)
        flat = np.full(self.heads * MEMBERS, -1e9, np.float32)
        flat[:self.k] = np.log(every[:self.k] / share[self.class_of(np.arange(self.k))])
        self.p["bm"] = flat.reshape(self.heads, MEMBERS)

    def train(self, texts: list[np.ndarray], rate: float, state: dict) -> None:
        """``texts``: numbers of the words of each, with the end. ``state``: what the optimiser keeps from call to call."""
        if not texts:
            return
        # many documents: more streams, so that a window costs less a word
        streams: list[list[np.ndarray]] = [[] for _ in range(min(max(STREAMS, len(texts) // 8), len(texts)))]
        sizes = [0] * len(streams)
        for t in sorted(texts, key=len, reverse=True):
            i = int(np.argmin(sizes))
            streams[i].append(t)
            sizes[i] += len(t)
        streams = [streams[i] for i in np.argsort(-np.array(sizes), kind="stable")]
        sizes = sorted(sizes, reverse=True)
        flat = [np.concatenate(s) for s in streams]
        begins = [np.zeros(n, bool) for n in sizes]
        for b, s in zip(begins, streams, strict=True):
            b[np.cumsum([0] + [len(t) for t in s[:-1]])] = True
        moment = state.setdefault("moment", {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()})
        h = np.zeros((len(streams), UNITS), np.float32)
        for a in range(0, sizes[0], STEPS):
            active = int(np.searchsorted(-np.array(sizes), -a, side="left"))  # streams longer than a
            steps, states, kept = min(STEPS, sizes[0] - a), [], []
            w, new = np.full((active, steps), -1), np.zeros((active, steps), bool)
            for i in range(active):
                own = flat[i][a:a + steps]
                w[i, :len(own)], new[i, :len(own)] = own, begins[i][a:a + steps]
            h = h[:active]
            for t in range(steps):
                h = np.where(new[:, t, None], 0, h)
                states.append(h)
                h, own = self.step(np.maximum(w[:, t], 0), h)
                kept.append(own)
            real = (w >= 0).T
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            back = np.zeros((steps, active, UNITS), np.float32)
            _, back[real] = self.log_probs(np.stack(states)[real], w.T[real], grad)
            # gradients of all steps' inputs and products, summed by word and over steps at once
            dx = np.empty((steps, active, 3 * UNITS), np.float32)
            dy = np.empty_like(dx)
            back_u = np.ascontiguousarray(self.p["u"].T)
            dh = np.zeros((active, UNITS), np.float32)
            for t in range(steps - 1, -1, -1):
                z, r, m, n = kept[t]
                x, y = dx[t], dy[t]
                own = dh * (1 - z)
                x[:, :UNITS] = own * z * (states[t] - n)
                own *= 1 - n * n
                x[:, 2 * UNITS:] = own
                x[:, UNITS:2 * UNITS] = own * m * r * (1 - r)
                y[:] = x
                y[:, 2 * UNITS:] *= r
                dh *= z
                dh += y @ back_u
                dh += back[t]
                dh[new[:, t]] = 0
            grad["u"] += np.concatenate(states).T @ dy.reshape(-1, 3 * UNITS)
            word = w.T[real]
            by = np.argsort(word, kind="stable")
            word = word[by]
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            grad["in"][word[begin]] = np.add.reduceat(dx[real][by], begin, axis=0)
            done = state["done"] = state.get("done", 0) + 1
            for k, g in grad.items():
                g /= max(1, real.sum()) / 8
                np.clip(g, -1, 1, out=g)
                m1, m2 = moment[k]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                self.p[k] -= rate * (m1 / (1 - 0.9 ** done)) / (np.sqrt(m2 / (1 - 0.99 ** done)) + 1e-6)

    def likelihoods(self, ids: np.ndarray, off: np.ndarray, number: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each text. ``ids``: words of all texts in a row, by which ``number`` and ``inside``
        (log probability within a tail class, 0 for modelled words) are looked up; id 0 follows each text as its end."""
        out = np.zeros(len(off) - 1)
        by_length = np.argsort(-np.diff(off), kind="stable")
        for some in range(0, len(by_length), ABREAST):
            texts = by_length[some:some + ABREAST]
            start, length = off[texts], off[texts + 1] - off[texts] + 1  # with the end
            h = np.zeros((len(texts), UNITS), np.float32)
            total = np.zeros(len(texts))
            t = 0
            while t < length[0]:
                states, words, owners = [], [], []
                for _ in range(max(STEPS, 65536 // max(1, int((length > t).sum())))):
                    n = int(np.searchsorted(-length, -t, side="left"))  # texts longer than t
                    if not n:
                        break
                    at = start[:n] + t
                    own = np.where(t == length[:n] - 1, 0, ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0)
                    h = h[:n]
                    states.append(h)
                    words.append(own)
                    owners.append(np.arange(n))
                    h = self.step(number[own], h)[0]
                    t += 1
                word, owner = np.concatenate(words), np.concatenate(owners)
                log_p = self.log_probs(np.concatenate(states), number[word])[0] + inside[word]
                total += np.bincount(owner, log_p, len(texts))
            out[texts] = total
        return out


def modelled(words: list[str], together: np.ndarray) -> Model:
    """A model, not yet trained, of the most frequent words, with the end."""
    words = [words[i] for i in word_order(together)]
    profile = np.full((PAIRS, TAILS), 0.1)
    for k in range(TAILS):
        own = pa.array([w for w in words[k * len(words) // TAILS:(k + 1) * len(words) // TAILS] if w], pa.large_string())
        if len(own):
            profile[:, k] += np.bincount(letter_pairs(own)[0], minlength=PAIRS)
    return Model(words, np.log(profile / profile.sum(axis=0)).astype(np.float32))


def trained(model: Model, texts: DataFrame) -> int:
    """Train the model on all texts, round by round; gives the words learned from, with the ends, of all rounds."""
    seen = 0
    for turn in range(EPOCHS * PARTS):
        shared = texts.sparkSession.sparkContext.broadcast(model)  # a fixed size
        rate = RATE * (1 - 0.8 * turn / (EPOCHS * PARTS))

        def learn(it: Iterable[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            m, state, n = copy.deepcopy(shared.value), {}, 0
            end = m.number.get(END, m.k)
            for _, own in batches_of(it, limit=BLOCK_BYTES):
                flat, off = words_of(own)
                coded = pc.dictionary_encode(flat)
                number = m.numbers(coded.dictionary)
                at = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.empty(0, np.int64)
                m.train([np.append(at[a:b], end) for a, b in zip(off, off[1:], strict=False)], rate, state)
                n += len(at) + len(own)
            if n:
                yield pieces(np.concatenate([v.reshape(-1).astype(np.float64) * n for v in m.p.values()]), n)

        total, n = summed(texts.filter(F.col("part") == turn % PARTS).select("text").mapInArrow(learn, "chunk int, n long, v binary"))
        shared.destroy()
        if n:
            seen += n
            edges = np.cumsum([v.size for v in model.p.values()])[:-1]
            model.p = {k: v.reshape(old.shape).astype(np.float32) for (k, old), v in zip(model.p.items(), np.split(total / n, edges), strict=True)}
    return seen


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    table = coded_blocks(docs, id_col, text_col, block_bytes)
    words = table.filter("idx IS NOT NULL").select("block", "idx", "word", "c")
    counts = written(words.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    tokens, types = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [r.word for r in counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(frequent).collect()]
    own = training_texts(docs, id_col, text_col)
    top = top if END in top or not top else [*top[:frequent - 1], END]
    model = modelled(top, co_occurrence(own, top))

    def number(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spelled = batch.column("word").cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(model.numbers(spelled).astype(np.int32))], ["word", "c", "number"])

    numbered = written(counts.mapInArrow(number, "word string, c long, number int"), "word-numbers")
    every = np.zeros(model.k + TAILS)
    for r in numbered.filter("c > 0").groupBy("number").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row a modelled word and tail class
        every[r.number] = r.n
        if r.number >= model.k:
            model.tail_n[r.number - model.k], model.tail_v[r.number - model.k] = r.n, r.v
    if tokens:
        model.start(every)
        trained(model, own)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    dictionary = words.select("block", "idx", "word").join(numbered, "word").select("block", "idx", "c", "number")
    texts = table.filter("idx IS NULL").select(F.col("block").alias("t_block"), "doc_id", "held_out", "ids")
    base_log = np.log10(tokens + 0.5 * (types + 1))

    def score(own: pa.Table, words: pa.Table) -> pa.Table:
        m = shared.value
        idx = words.column("idx").to_numpy()
        n = int(idx.max()) + 1 if len(idx) else 1
        c, num = np.zeros(n), np.zeros(n, np.int64)
        c[idx], num[idx] = words.column("c").to_numpy(), words.column("number").to_numpy()
        raw = [x.as_buffer() for x in own.column("ids").combine_chunks()] if own.num_rows else []
        ids = np.concatenate([np.frombuffer(x, "<i4") for x in raw]) if raw else np.empty(0, np.int32)
        off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
        sums = lambda per_id: np.diff(np.concatenate([[0], np.cumsum(per_id[ids])])[off]) + per_id[0]
        size = np.diff(off) + 1
        base = sums(np.log10(c + 0.5)) - size * base_log
        if tokens:
            tail = np.maximum(num - m.k, 0)
            inside = np.where(num >= m.k, np.log((c + 0.5) / (m.tail_n[tail] + 0.5 * (m.tail_v[tail] + 1))), 0.0)
            log_p = m.likelihoods(ids, off, num, inside) / np.log(10)
        else:
            log_p = np.zeros(len(size))
        k = own.num_rows
        return pa.table({"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": pa.array(size), "n_known": pa.array(sums((c > 0).astype(np.int64))),
                         "train_tokens": pa.array([int(tokens)] * k, pa.int64()), "base_score": pa.array(base), "score": pa.array(log_p)})

    return (texts.groupBy("t_block").cogroup(dictionary.groupBy("block"))
            .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
