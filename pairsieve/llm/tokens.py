"""Token ids of whole texts, word by word with a bounded cache.

The vocabulary's rules never merge across a space or a line feed, so a text's
ids are the ids of its words behind each other. A word is encoded by the
tokenizers library once per Python worker as long as the cache has room.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

CACHE_WORDS = 600_000
LONGEST_CACHED = 48
PROBES = ("word", "ciónñaé", "a", "zeitgemäß")  # where a vocabulary file has other rules before its model, these differ and words go the whole way


class _Slots(dict):
    """Word -> place; an unknown word gets the next place and waits in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.free = 0

    def __missing__(self, word: str) -> int:
        place = self[word] = self.free
        self.free += 1
        self.fresh.append(word)
        return place


class WordEncoder:
    """Encodes texts with a word-based BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.model = self.tokenizer.model
        self.bytes_as_letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_model = all(self._by_model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.ids = np.zeros(1 << 16, dtype=self.kind)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.n_ids = 0
        self.passed_by = 0

    def _by_model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self._letters(word))]

    def _letters(self, word: str) -> str | None:
        """The word as the model sees it, if it is one run of lower-case Latin-1 letters, which no rule before the model parts or changes; else None."""
        if not word.isalpha() or word != word.lower():
            return None
        if word.isascii():
            return word
        if max(word) > "\xff":
            return None
        return self.bytes_as_letters.pre_tokenize_str(word)[0][0]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of single words.

        Letters with one comma or full stop behind them are encoded apart: the
        splitting rule parts them there, and the sign stands alone. Runs of
        letters go to the library's model directly, without the cost of an
        encoding object for each; all others go the whole way.
        """
        plain = [w[:-1] if w[-1:] in (",", ".") and w[:-1].isalpha() and w[:-1].lower().isalpha() else w for w in words]
        letters = [self._letters(p) for p in plain] if self.by_model else [None] * len(plain)
        rest = [p for p, x in zip(plain, letters, strict=True) if x is None]
        bare = self.tokenizer.encode_batch_fast([*rest, ",", "."], add_special_tokens=False)
        signs = {",": bare[-2].ids, ".": bare[-1].ids}
        whole, tokenize = iter(bare), self.model.tokenize
        ids = [next(whole).ids if x is None else [t.id for t in tokenize(x)] for x in letters]
        return [i if p is w else i + signs[w[-1]] for w, p, i in zip(words, plain, ids, strict=True)]

    def _fill(self, words: list[str]) -> None:
        """Store the ids of fresh words, whose places are the last ones."""
        ids = self._encoded(words)
        first, stop = self.slots.free - len(words), self.slots.free
        if stop > len(self.starts):
            self.starts, self.lengths = (np.concatenate((a, np.zeros(max(stop, len(a)), dtype=a.dtype))) for a in (self.starts, self.lengths))
        n = np.array(list(map(len, ids)), dtype=np.int64)
        total = int(n.sum())
        if self.n_ids + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(total, len(self.ids)), dtype=self.kind)))
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=total)
        self.lengths[first:stop] = n
        self.starts[first:stop] = self.n_ids + np.cumsum(n) - n
        self.n_ids += total

    @staticmethod
    def _plain(text: str) -> str:
        """Lower case where this can't change the result: Latin-1 letters, no special token's string."""
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text (uint32), without special tokens; null is empty."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        words = self._plain(text).replace("\n", " ").split(" ")
        slots = self.slots
        before, ids_before = slots.free, self.n_ids
        at = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))
        fresh = slots.fresh
        if fresh:
            self._fill(fresh)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        out = self.ids[np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)].astype(np.uint32)
        if fresh:
            slots.fresh = []
            if slots.free > self.cache_words:  # full: these words stay outside, and when as many have passed, it starts anew
                for w in fresh:
                    del slots[w]
                slots.free, self.n_ids = before, ids_before
                self.passed_by += len(fresh)
                if self.passed_by > self.cache_words:
                    self._clear()
            else:
                for w in fresh:
                    if len(w) > LONGEST_CACHED:
                        del slots[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file: a worker loads each file once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
