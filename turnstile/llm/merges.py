"""Merges of a byte-level BPE vocabulary for many strings at once.

Strings of one length form a matrix of symbol ids; each round merges the
leftmost pair of least rank in every row, until no row has a pair left.  Pair ranks
come from an open-addressing table in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from .tables import PairTable
from .vocab import load, resolve

_NONE = np.int32(2**31 - 1)
#: Symbols above which a string is left to the library.
LONGEST = 48
ROWS = 20_000


class Merger:
    def __init__(self, vocab: str) -> None:
        self.tokenizer = load(vocab)
        with open(resolve(vocab), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.byte_id, self.last_id = self._alphabet(ids, suffix)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.pairs = PairTable(left, right, rank=(np.arange(len(pairs)), _NONE), made=(made, 0))

    @staticmethod
    def _alphabet(ids: dict, suffix: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each byte inside a string, and at its end.

        Byte-level vocabularies write printable bytes as themselves and the
        others, in order, as the characters from 256 on."""
        chars, extra = [], 256
        for b in range(256):
            shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
            chars.append(chr(b) if shown else chr(extra))
            extra += not shown
        return (np.array([ids[c] for c in chars], np.int32), np.array([ids[c + suffix] for c in chars], np.int32))

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        slot = self.pairs.find(a, b)
        return self.pairs.rank[slot], self.pairs.made[slot]

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols -> the rows' ids one after another, and each row's number of ids."""
        n, width = symbols.shape
        symbol = symbols.ravel().copy()
        after = np.arange(1, n * width + 1)  # the symbol to the right, a row's end is the next row's start
        before = np.arange(-1, n * width - 1)
        alive = np.ones(n * width, bool)
        rank = np.full((n, width), _NONE, np.int32)
        made = np.zeros((n, width), np.int32)
        if width > 1:
            r, m = self._find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
            rank[:, :-1], made[:, :-1] = r.reshape(n, -1), m.reshape(n, -1)
        table, rank, made = rank, rank.reshape(-1), made.reshape(-1)
        rows = np.arange(n)
        while True:
            at = rows * width + table[rows].argmin(1)
            more = rank[at] != _NONE
            rows, at = rows[more], at[more]
            if not len(rows):
                break
            gone = after[at]
            right, left = after[gone], before[at]
            symbol[at] = made[at]
            after[at] = right
            alive[gone] = False
            rank[gone] = rank[at] = _NONE
            inside = right < (rows + 1) * width
            here, right = at[inside], right[inside]
            before[right] = here
            inside = left >= rows * width
            there, left = at[inside], left[inside]
            one, two = np.concatenate([here, left]), np.concatenate([right, there])
            rank[one], made[one] = self._find(symbol[one], symbol[two])
        return symbol[alive], alive.reshape(n, width).sum(1)

    def _each(self, strings: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(which strings, their ids one after another, how many ids each has)."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        for length in np.unique(lengths).tolist():
            which = np.nonzero(lengths == length)[0]
            if length == 0 or length > LONGEST:
                for k in which.tolist():
                    ids = self._library(strings[k]) if length else np.empty(0, np.int32)
                    yield [k], ids, np.array([len(ids)])
                continue
            for part in range(0, len(which), ROWS):
                some = which[part:part + ROWS].tolist()
                raw = np.frombuffer(b"".join([strings[k] for k in some]), np.uint8).reshape(len(some), length)
                symbols = self.byte_id[raw]
                symbols[:, -1] = self.last_id[raw[:, -1]]
                yield some, *self._merge(symbols)

    def counts(self, strings: list[bytes]) -> list[int]:
        """Number of ids of each byte string, merged as one pre-token."""
        found = np.zeros(len(strings), np.int64)
        for which, _, size in self._each(strings):
            found[which] = size
        return found.tolist()

    def ids(self, strings: list[bytes]) -> list[bytes]:
        """Ids of each byte string, merged as one pre-token, as little-endian 32-bit bytes."""
        found: list = [b""] * len(strings)
        for which, ids, size in self._each(strings):
            raw = ids.astype("<u4").tobytes()
            ends = (4 * np.cumsum(size)).tolist()
            for k, start, end in zip(which, [0, *ends], ends):
                found[k] = raw[start:end]
        return found

    def _library(self, string: bytes) -> np.ndarray:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(string.decode("utf-8"))
        return np.array([t.id for piece, _ in cut for t in self.tokenizer.model.tokenize(piece)], np.int32)
