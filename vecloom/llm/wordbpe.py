"""Token ids of whole texts by a word-level BPE file of the tokenizers library.

The file's normaliser and pre-tokeniser never look across white space, so the ids of a text are the ids of its
white-space-separated words, one after another. Every distinct word is encoded once and kept in a table of bounded
size; a text is then a gather from that table. Words made of Latin letters, with ASCII signs after them or none,
need no normaliser but lower case and go straight to the library's model.
"""

from __future__ import annotations

import re
from operator import attrgetter

import numpy as np

#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Letters, and ASCII signs behind them: not "'", which starts contractions, nor "<", which starts special tokens.
_EASY = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_MARK = "\x01"
_ID = attrgetter("id")


def byte_alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in _PLAIN]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Index(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class WordBpe:
    """limit: the number of words kept between calls; beyond it only those met again since the last time stay, at most
    half of it. That bounds memory and changes no result."""

    def __init__(self, path: str, end_id: int, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.end_id, self.limit = Tokenizer.from_file(path), end_id, limit
        self.model = self.library.model
        self.wide = max(self.library.get_vocab_size(), end_id + 1) > 1 << 16  # else 16 bits hold every id
        alphabet = byte_alphabet()
        self.spelled = {ord(c): "".join(alphabet[b] for b in c.encode()) for c in map(chr, range(256))}
        self.signs: dict[str, list[int]] = {"": []}
        self.mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.index = _Index()
        self.index[b""] = 0  # no word: the end of a text
        self.pool, self.used = np.array([self.end_id], np.int32), 1
        self.starts, self.sizes, self.hits = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)

    def _trim(self) -> None:
        self.hits[0] = np.iinfo(np.int64).max
        least, half = 2, self.limit // 2 + 1
        if np.count_nonzero(self.hits >= least) > half:
            least = np.partition(self.hits, -half)[-half] + 1
        stay = np.flatnonzero(self.hits >= least)
        words = [*self.index]
        self.index = _Index()
        self.index.update((words[at], i) for i, at in enumerate(stay.tolist()))
        sizes = self.sizes[stay]
        upto = np.cumsum(sizes)
        self.pool = self.pool[np.repeat(self.starts[stay] - upto + sizes, sizes) + np.arange(upto[-1])]
        self.starts, self.sizes, self.hits, self.used = upto - sizes, sizes, np.zeros(len(stay), np.int64), len(self.pool)

    def _by_library(self, words: list[str]) -> list[list[int]]:
        """Many words in one call, with a mark between them that no word holds."""
        out: list[list[int]] = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            if len(self.mark) != 1 or any(_MARK in w for w in some):
                out += [self.library.encode(w, add_special_tokens=False).ids for w in some]
                continue
            ids = np.array(self.library.encode(f" {_MARK} ".join(some), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark[0])
            out += [x.tolist() for x in np.split(np.delete(ids, cuts), cuts - np.arange(len(cuts)))]
        return out

    def _learn(self) -> None:
        """The new words' ids go to the pool. No list outlives its word, so the collector finds nothing to walk."""
        new, self.index.new = self.index.new, []
        easy, tokenize, spelled = _EASY.fullmatch, self.model.tokenize, self.spelled
        flat, ends, hard, hard_at = [], [], [], []
        for at, word in enumerate(new):
            if word.isalpha():  # ASCII letters stand for themselves
                flat.extend(map(_ID, tokenize(word.lower().decode())))
            elif m := easy(text := word.decode()):
                flat.extend(map(_ID, tokenize(m[1].lower().translate(spelled))))
                if (ids := self.signs.get(m[2])) is None:
                    ids = [t.id for t in tokenize(m[2])]
                    if len(self.signs) < 10_000:
                        self.signs[m[2]] = ids
                flat += ids
            else:
                hard.append(text)
                hard_at.append(at)
            ends.append(len(flat))
        sizes, places = np.diff(np.array(ends, np.int64), prepend=0), np.array(hard_at, np.int64)
        starts = np.array(ends, np.int64) - sizes
        found = self._by_library(hard)
        sizes[places] = np.fromiter(map(len, found), np.int64, len(found))
        starts[places] = len(flat) + np.cumsum(sizes[places]) - sizes[places]
        for ids in found:
            flat += ids
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(flat), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(flat)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and the number of ids of each text."""
        if len(self.index) > self.limit:
            self._trim()
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += t.split()
            words.append(b"")
            counts[i] = len(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn()
        self.hits = np.bincount(at, minlength=len(self.index)) + np.pad(self.hits, (0, len(self.index) - len(self.hits)))
        sizes = self.sizes[at]
        upto = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.diff(upto[counts - 1], prepend=0) if len(texts) else counts
