"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from polysafe.llm.common import text_buffer

#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 600_000
#: Words encoded in one call; what a call returns is much larger than the ids.
_CALL = 5_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_MARK[ord("'")] = False  # an apostrophe may belong to a contraction
#: Words of Latin letters only: lower case and canonical composition are a letter's own affair.
_PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


class WordTokenizer:
    """Encodes each distinct word once.

    The tokenizer lower-cases, drops white space and never joins tokens across
    it, so a text's ids are those of its words in order.  A letter run and an
    adjacent ASCII mark are separate tokens for it as well, so they are parted
    before distinct words are counted.  Texts with special-token brackets or
    a capital sigma (whose lower case depends on its neighbours) are encoded
    whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What the normaliser and the pre-tokenizer make of each Latin letter.
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        normal = self.tokenizer.normalizer.normalize_str
        self.letters = {c: split(normal(chr(c)))[0][0] for c in range(0xC0, 0x100) if _PLAIN.fullmatch(chr(c))}
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """A word of Latin letters is one piece for the tokenizer and goes to its model at once; others go all the way."""
        for k in range(0, len(words), _CALL):
            call = words[k:k + _CALL]
            plain = [bool(_PLAIN.fullmatch(w)) for w in call]
            rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(call, plain) if not p], add_special_tokens=False))
            model = self.tokenizer.model.tokenize
            ids = [[t.id for t in model(w if w.isascii() else w.translate(self.letters))] if p else next(rest).ids for w, p in zip(call, plain)]
            at = int(self.ends[-1])
            flat = np.array([x for got in ids for x in got], np.uint32)
            if at + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            self.ids[at:at + len(flat)] = flat
            self.known.update(zip(call, range(len(self.ends) - 1, len(self.ends) - 1 + len(call))))
            self.ends = np.concatenate([self.ends, at + np.cumsum([len(got) for got in ids])])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): each text's ids and then ``end_id``; a null text is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, "Σ")).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        words, counts = self._words(plain)
        number = words.dictionary_encode()
        distinct = number.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_WORDS:
            self.known, self.ends = {}, np.zeros(1, np.int64)
        got = list(map(self.known.get, distinct))
        unknown = [w for w, k in zip(distinct, got) if k is None]
        if unknown:
            self._learn(unknown)
            got = list(map(self.known.get, distinct))
        slot = np.array(got, np.int64)[number.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        ends = self.ends
        start, size = ends[slot], ends[slot + 1] - ends[slot] if len(slot) else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])] if len(slot) else np.zeros(0, np.uint32)
        at = upto[np.concatenate(([0], np.cumsum(counts)))]
        pieces = [flat[at[k]:at[k + 1]] for k in range(len(texts))]
        for k in np.flatnonzero(odd):
            pieces[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        end = np.array([end_id], np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces]))).astype(np.int64)
        return np.concatenate([x for p in pieces for x in (p, end)]) if pieces else np.zeros(0, np.uint32), offsets

    @staticmethod
    def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        buf, offs = text_buffer(texts)
        low = _LOWER[buf]
        letter, mark = _LETTER[low], _MARK[low]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1 if len(low) else np.zeros(0, np.int64)
        parted = np.insert(low, cut, 32)
        moved = offs + np.searchsorted(cut, offs, side="left")
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(moved), pa.py_buffer(parted)))
        words = split.values
        sizes = np.diff(split.offsets.to_numpy())
        return words, sizes


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its memory of words, per worker process."""
    return WordTokenizer(path)
