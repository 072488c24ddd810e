"""Token ids of whole texts by a public tokenizer, a word at a time.

The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in
a row. Each distinct part of a word is encoded
once and remembered, up to PARTS of them a worker.

Words of printable ASCII and precomposed Latin letters are cut as the tokenizer's own splitter
cuts them (letters, single digits, runs of other signs, English endings after an apostrophe) and
each part is given to the tokenizer's BPE model directly, which is several times faster than the
full call; all other words take the full call. Tests hold both against whole-text encoding.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skychan.llm.common import repeat_ranges, words_of

#: Parts of words that a worker remembers; beyond it starts anew.
PARTS = 600_000
_LETTERS = "a-zß-öø-ňŊ-ſ"
_PLAIN = "^[!-~À-ÖØ-öø-įı-ňŊ-ž]+$"
_CUT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+"
#: Neither is in a word: between parts, and before a word that takes the full call.
_GAP, _WHOLE = " ", "\t"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}
        self.model = self.tokenizer.model
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's own encoder: a worker serves many tasks and keeps its words."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _learn(self, parts: list[str]) -> None:
        if len(self.known) + len(parts) > PARTS:
            self._forget()
        new = [p for p in parts if p not in self.known]
        if not new:
            return
        whole = [p[1:] for p in new if p[0] == _WHOLE]
        called = iter(self.tokenizer.encode_batch(whole, add_special_tokens=False)) if whole else iter(())
        tokenize, signs = self.model.tokenize, self.signs
        ids = [next(called).ids if p[0] == _WHOLE else [t.id for t in tokenize(p if p.isascii() else p.translate(signs))] for p in new]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n, used, more = len(self.known), int(self.ends[len(self.known)]), int(size.sum())
        for name, need in (("ids", used + more), ("ends", n + len(new) + 1)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.empty(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.ids[used:used + more] = np.fromiter((t for x in ids for t in x), np.uint32, more)
        self.ends[n + 1:n + 1 + len(new)] = used + np.cumsum(size)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def _parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all words in a row, and where each word's begin."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, special))
        cut = pc.replace_substring_regex(pc.utf8_lower(words), _CUT, "\\0" + _GAP)
        cut = pc.if_else(plain, pc.utf8_rtrim(cut, _GAP), pc.binary_join_element_wise(pa.scalar(_WHOLE, pa.large_string()), words, pa.scalar("", pa.large_string())))
        parts = pc.split_pattern(cut, _GAP)
        return parts.flatten(), parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts in a row, and where each text's begin (one more than texts)."""
        words, off = words_of(texts, lower=False)
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = pc.dictionary_encode(words)
        parts, begin = self._parts(coded.dictionary)
        cut = pc.dictionary_encode(parts)
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        start = self.ends[place]
        # ids of the distinct words in a row, then of all words
        at = cut.indices.to_numpy(zero_copy_only=False)
        length = (self.ends[place + 1] - start)[at]
        word_ids = self.ids[repeat_ranges(start[at], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[begin]
        at = coded.indices.to_numpy(zero_copy_only=False)
        length = np.diff(ends)[at]
        return word_ids[repeat_ranges(ends[at], length)], np.concatenate([[0], np.cumsum(length)])[off]
