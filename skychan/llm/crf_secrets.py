"""Operator 7: secrets by fixed patterns and a linear-chain conditional random field.

Base spans are the matches of three patterns (the contract's). The field adds spans: a text's tokens,
runs of the characters that secrets are written in, are tagged begin, inside or outside. Its features
are the token's shape, its neighbours (words that announce a secret, an equals sign or colon between) and
figures of the whole file. It is trained in numpy by gradient of the log-likelihood, on
windows of tokens around base spans (at most ``max_windows``) and around other places (twice as many),
chosen by hash among all places of all texts. Tokens that look like secrets but that no pattern
announces count as unlabelled, not as outside. In half of the windows the announcing neighbours are
masked, so that it learns what secrets look like by themselves. Decoding is by Viterbi.

A tagged stretch of tokens is on the best path only if it scores more than leaving it untagged. The most
that a token can add, whatever its neighbours, is known from its own features; a text all of whose
tokens stay below zero by that bound has no added span, and needs no path. These bounds are computed
once per distinct token of a slice. This is exact. All other texts are decoded whole.

Defined results. Null and empty text: no spans; base_sha256 of the empty string. Null doc_id and
repeated rows: rows like others. Texts are read whole. Empty table: no rows. A text without
characters of secrets: no spans. Added spans never overlap base ones.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skychan.llm.common import batches_of, words_of

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+=*")
ANNOUNCE = re.compile(r"(?:passw|passwd|pwd|secret|token|api_?key|auth|bearer|credential|private|access)", re.I | re.A)
DIGITS, WORD, WORD_END = re.compile(r"[0-9]+"), re.compile(r"[^\x20\x09-\x0D]*"), re.compile(r"[^\x20\x09-\x0D]*\Z")
#: Shape features: a pattern each.
SHAPES = (r".{8,}", r".{12,}", r".{16,}", r".{24,}", r".{32,}", r"[0-9]", r"[a-z]", r"[A-Z]", r"^[0-9]+=*$", r"^[0-9a-f]+$", r"^[A-Z0-9]+$",
          r"^[A-Za-z]+=*$", r"(?:[A-Za-z][0-9]|[0-9][A-Za-z]).*(?:[A-Za-z][0-9]|[0-9][A-Za-z])", r"(?:(?:[A-Za-z][0-9]+[A-Za-z]).*){3}", r"\.", r"[/+_]", r"-", r"^AKIA", r"=$")
#: Then: announced by the token before, equals sign or colon before, both, next token has digits; the file announces a secret, share of tokens with digits.
N_FEATURES = 1 + len(SHAPES) + 6
MAX_WINDOWS, HALF = 800, 6
#: The field's tags need this much more score a span than no tag; shorter tokens are never added.
MARGIN, LEAST = 3.0, 12
#: Characters of the texts, and places in them, that wait before their windows are made.
WAITING_CHARS, WAITING_PLACES = 16_000_000, 100_000
#: Each byte as h if it is a hex digit, else as a blank: a run of them is found faster than by the pattern.
HEX_BYTES = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Share of the known secrets that may look less like one than a token taken for unlabelled.
SPIES = 0.1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind. Patterns whose fixed words the text lacks aren't tried."""
    out = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(k in low for k in ("passw", "secret", "token", "api")) and ("=" in text or ":" in text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in text.encode("utf-8", "replace").translate(HEX_BYTES):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shape_matrix(tokens: pa.Array) -> np.ndarray:
    """Own features of each token: one, then the shapes."""
    return np.stack([np.ones(len(tokens), bool)] + [pc.match_substring_regex(tokens, p).to_numpy(zero_copy_only=False) for p in SHAPES], axis=1).astype(np.float64)


def file_figures(text: str) -> tuple[float, float]:
    """Whether the file announces a secret anywhere, and the share of its words that have digits."""
    return float(ANNOUNCE.search(text) is not None), min(1.0, 10 * sum(1 for _ in digit_words(text)) / (1 + text.count(" ")))


def sequence(text: str, figures: tuple[float, float], start: int = 0, end: int | None = None) -> tuple[list[re.Match], np.ndarray]:
    """Tokens of a text, or of a part of it, and their features."""
    tokens = list(TOKEN.finditer(text, start, len(text) if end is None else end))
    x = np.zeros((len(tokens), N_FEATURES))
    if not tokens:
        return tokens, x
    x[:, :1 + len(SHAPES)] = shape_matrix(pa.array([m[0] for m in tokens], pa.large_string()))
    announced = np.array([False] + [ANNOUNCE.search(m[0]) is not None for m in tokens[:-1]])
    signed = np.array([False] + [a[0].endswith("=") or any(c in text[a.end():b.start()] for c in "=:") for a, b in zip(tokens, tokens[1:], strict=False)])
    digits = x[:, 1 + SHAPES.index("[0-9]")] > 0
    x[:, -6], x[:, -5], x[:, -4], x[:-1, -3] = announced, signed, announced & signed, digits[1:]
    x[:, -2:] = figures
    return tokens, x


def tags_of(tokens: list[re.Match], spans: list[tuple[str, int, int]], text: str) -> np.ndarray:
    """0 outside, 1 begin, 2 inside: a secret's value begins behind what announces it."""
    y = np.zeros(len(tokens), np.int64)
    values = []
    for kind, a, b in spans:
        if kind == "assign":
            m = ASSIGN.match(text, a)
            a = m.start(2) if m else a
        values.append((a, b))
    for a, b in values:
        own = [i for i, m in enumerate(tokens) if m.start() >= a and m.start() < b]
        for k, i in enumerate(own):
            y[i] = max(y[i], 1) if k == 0 else (y[i] or 2)
    return y


class Field:
    """Weights: features by tag (outside has none, begin and inside share theirs), and transitions [from, to]; inside never follows outside."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, real: np.ndarray, steps: int = 100, rate: float = 0.15, decay: float = 2e-4) -> Field:
        """x: windows by places by features; y: tags; real: places that are tokens. Adam on the whole sample."""
        n, length, f = x.shape
        w, t = np.zeros((f, 3)), np.zeros((3, 3))
        w[0, 1:] = -4
        barred = np.zeros((3, 3))
        barred[0, 2] = -1e9
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        one = np.eye(3)
        seen_w = np.einsum("nlf,nlk->fk", x * real[..., None], one[y])
        both = real[:, 1:] & real[:, :-1]
        seen_t = np.einsum("nli,nlj,nl->ij", one[y[:, :-1]], one[y[:, 1:]], both)
        for step in range(1, steps + 1):
            e = x @ w
            e[..., 0] = 0
            e[:, 0, 2] = -1e9
            e = np.where(real[..., None], e, np.array([0, -1e9, -1e9]))
            move = t + barred
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for i in range(1, length):
                a[:, i] = np.logaddexp.reduce(a[:, i - 1][:, :, None] + move[None], axis=1) + e[:, i]
            for i in range(length - 2, -1, -1):
                b[:, i] = np.logaddexp.reduce(move[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            pair = np.exp(a[:, :-1, :, None] + move[None, None] + (e + b)[:, 1:, None, :] - z[:, None, None, None])
            gw = (seen_w - np.einsum("nlf,nlk->fk", x, p)) / n - decay * w
            gt = (seen_t - np.einsum("nlij,nl->ij", pair, both.astype(float))) / n - decay * t
            gw = np.stack([np.zeros(f), gw[:, 1] + gw[:, 2], gw[:, 1] + gw[:, 2]], axis=1)
            for v, g, k in ((w, gw, 0), (t, gt, 2)):
                state[k] += 0.1 * (g - state[k])
                state[k + 1] += 0.01 * (g * g - state[k + 1])
                v += rate * (state[k] / (1 - 0.9 ** step)) / (np.sqrt(state[k + 1] / (1 - 0.99 ** step)) + 1e-8)
        return cls(w, t)

    def may_tag(self, own: np.ndarray, announced: bool = True) -> np.ndarray:
        """Tokens that could be in a tagged stretch that gains something, by their own features.

        A stretch of k tokens gains at most the sum of its tokens' scores, k - 1 moves within and the
        moves in and out, against k + 1 moves from outside to outside. Where no token's score and best move
        are above zero, and the moves in and out don't make up for it, no stretch gains.
        ``announced``: whether features of announced secrets can be on.
        """
        n = own.shape[1]
        around = np.maximum(self.w[n:, 1], 0)
        most = around.sum() if announced else around[[1, 3, 5]].sum()
        within = self.t[1:, 1:].max() - self.t[0, 0]
        in_out = self.t[0, 1] + self.t[1:, 0].max() - self.t[0, 0] - MARGIN - self.t[1:, 1:].max()
        return own @ self.w[:n, 1] + most + within + max(0.0, in_out) >= 0

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi over the whole sequence; each begin costs MARGIN."""
        y = np.zeros(len(x), np.int64)
        score = (x @ self.w[:, 1]).tolist()
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.t.tolist()
        o, b, i, back = 0.0, -np.inf, -np.inf, []
        for e in score:
            to_o, to_b, to_i = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib), (-np.inf, b + bi, i + ii)
            back.append((to_o.index(max(to_o)), to_b.index(max(to_b)), to_i.index(max(to_i))))
            o, b, i = max(to_o), max(to_b) + e - MARGIN, max(to_i) + e
        last = (o + oo, b + bo, i + io)
        tag = last.index(max(last))
        for k in range(len(score) - 1, -1, -1):
            y[k] = tag
            tag = back[k][tag]
        return y


def digit_words(text: str) -> Iterator[tuple[int, int]]:
    """Where the words with digits are, each once."""
    end = 0
    for m in DIGITS.finditer(text):
        if m.start() >= end:
            start = m.start() - len(WORD_END.search(text[max(0, m.start() - 200):m.start()])[0])
            end = WORD.match(text, m.end()).end()
            yield start, end


class Smallest:
    """The ``limit`` different smallest keys with what was made for them."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.made = limit, [], {}

    def wants(self, key: int) -> bool:
        return key not in self.made and (len(self.heap) < self.limit or key < -self.heap[0])

    def add(self, key: int, value: tuple) -> None:
        self.made[key] = value
        heapq.heappush(self.heap, -key)
        if len(self.heap) > self.limit:
            del self.made[-heapq.heappop(self.heap)]


def training_windows(docs: DataFrame, text_col: str, max_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows around base spans and around other places (words with digits, and the middle of each text), among all places of all
    texts: those whose words have the smallest hashes; 3 * max_windows at most reach the driver. Places with equal words around count once, so
    copies don't crowd out others, and the choice doesn't depend on how rows are partitioned."""
    length, reach = 2 * HALF + 1, 400

    def window(text: str, spans: list, figures: tuple[float, float], a: int, b: int, secret: bool, key: int) -> tuple[bytes, bytes] | None:
        tokens, x = sequence(text, figures, max(0, a - reach), min(len(text), b + reach))
        tokens, x = tokens[1:-1], x[1:-1]  # the outer ones may be cut off
        y = tags_of(tokens, spans, text)
        i = next((k for k, m in enumerate(tokens) if m.end() > a and (not secret or y[k] == 1)), -1)
        if i < 0:
            return None
        lo = max(0, i - HALF)
        own, tags = x[lo:lo + length].copy(), y[lo:lo + length].copy()
        if key & 2:
            own[:, -6:-3], own[:, -2] = 0, 0
        if tags[0] == 2:
            tags[0] = 1
        return own.astype("<f4").tobytes(), tags.astype("<i1").tobytes()

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {True: Smallest(max_windows), False: Smallest(2 * max_windows)}
        waiting, size = [], 0

        def settle() -> None:
            """Windows are made from the smallest hash on, so that few are made that smaller ones push out again."""
            nonlocal size
            for key, secret, a, b, text, spans in sorted(waiting, key=lambda w: w[0]):
                if kept[secret].wants(key):
                    made = window(text, spans, file_figures(text), a, b, secret, key)
                    if made is not None:
                        kept[secret].add(key, made)
            waiting.clear()
            size = 0

        for _, texts in batches_of(it):
            for text in texts.to_pylist():
                spans, before = base_spans(text), len(waiting)
                places = chain(((a, b, True) for _, a, b in spans), ((a, b, False) for a, b in digit_words(text)), ((len(text) // 2, len(text) // 2, False),))
                for a, b, secret in places:
                    key = xxhash.xxh64_intdigest(text[max(0, a - 40):b + 40]) >> 1
                    if kept[secret].wants(key):
                        waiting.append((key, secret, a, b, text, spans))
                size += len(text) if len(waiting) > before else 0
                if size > WAITING_CHARS or len(waiting) > WAITING_PLACES:
                    settle()
        settle()
        rows = [(key, secret, *made) for secret, best in kept.items() for key, made in sorted(best.made.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["key", "secret", "x", "y"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "key long, secret boolean, x binary, y binary")
    # a key's windows differ only by what stands farther away: the least one stays
    found = found.groupBy("secret", "key").agg(F.min(F.struct("x", "y")).alias("v")).select("secret", "key", "v.x", "v.y")
    rank = F.row_number().over(Window.partitionBy("secret").orderBy("key", "x"))
    rows = found.withColumn("rank", rank).filter(F.col("rank") <= 2 * max_windows).filter(~F.col("secret") | (F.col("rank") <= max_windows)).orderBy("secret", "rank").collect()
    x, y, real = np.zeros((len(rows), length, N_FEATURES)), np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), bool)
    for i, r in enumerate(rows):
        own = np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES)
        x[i, :len(own)], y[i, :len(own)], real[i, :len(own)] = own, np.frombuffer(r.y, "<i1"), True
    return x, y, real


def trained(x: np.ndarray, y: np.ndarray, real: np.ndarray) -> Field | None:
    """The patterns say which tokens are secrets, not which are none: tokens that look like the secrets without being announced are unlabelled.
    A first field shows them, by the score of their shapes alone: they reach what all but SPIES of the known secrets
    reach. Windows that hold one teach nothing about what is outside, and a second field learns from the others."""
    if not (y > 0).any():
        return None
    first = Field.train(x, y, real)
    shape = x[..., :1 + len(SHAPES)] @ first.w[:1 + len(SHAPES), 1]
    least = np.quantile(shape[real & (y == 1)], SPIES)
    alike = (real & (y == 0) & (shape >= least)).any(axis=1)
    if not alike.any() or not (y[~alike] > 0).any():
        return first
    return Field.train(x[~alike], y[~alike], real[~alike])


def added_spans(text: str, field: Field, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    tokens, x = sequence(text, file_figures(text))
    y = field.decode(x)
    out, i = [], 0
    while i < len(y):
        if y[i]:
            j = i + 1
            while j < len(y) and y[j] == 2:
                j += 1
            a, b = tokens[i].start(), tokens[j - 1].end()
            if b - a >= LEAST and not any(s < b and a < e for _, s, e in spans):
                out.append(("crf", a, b))
            i = j
        else:
            i += 1
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """A row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    x, y, real = training_windows(docs, text_col, max_windows)
    field = trained(x, y, real)

    def scan(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of(it):
            needs = np.zeros(len(texts), bool)
            if field is not None:
                words, off = words_of(texts, lower=False)
                coded = pc.dictionary_encode(words)
                tokens = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring_regex(coded.dictionary, r"[^A-Za-z0-9+/_.=-]+", " "), r"(=+)", r"\1 "), " "), " ")
                flat, begin = tokens.flatten(), tokens.offsets.to_numpy(zero_copy_only=False)
                own, real = shape_matrix(flat), pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
                at = coded.indices.to_numpy(zero_copy_only=False)
                announced = pc.match_substring_regex(texts, ANNOUNCE.pattern, ignore_case=True).to_numpy(zero_copy_only=False)
                for said in (True, False):
                    hot = np.diff(np.concatenate([[0], np.cumsum(field.may_tag(own, said) & real)])[begin]) > 0
                    needs |= (np.diff(np.concatenate([[0], np.cumsum(hot[at])])[off]) > 0) & (announced | (not said))
            rows = []
            for text, need in zip(texts.to_pylist(), needs, strict=True):
                base = base_spans(text)
                added = added_spans(text, field, base) if need else []
                said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                everything = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in everything), len(added)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"))
