"""Byte-pair merges of many words at once, with arrays.

The rules are those of the tokenizer's own file: a word is its bytes, the last marked as the word's end; of all
neighbours that have a rule the one of lowest rank is merged, of equals the leftmost, until none is left.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1) << 40


class _Table:
    """A map from 32-bit keys to numbers: keys that meet in one table go to the next."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18):
        self.shift, self.levels = np.uint32(32 - bits), []
        left = np.arange(len(keys))
        for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1):
            at = self._at(keys[left], np.uint32(factor))
            _, first = np.unique(at, return_index=True)
            table = np.zeros(1 << bits, np.int64)
            own = np.full(1 << bits, -1, np.int64)
            own[at[first]] = keys[left[first]]
            table[at[first]] = values[left[first]]
            self.levels.append((np.uint32(factor), own, table))
            left = np.delete(left, first)
            if not len(left):
                return
        raise ValueError("keys do not fit")

    def _at(self, keys: np.ndarray, factor: np.uint32) -> np.ndarray:
        return (keys.astype(np.uint32) * factor) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NONE)
        for factor, own, table in self.levels:
            at = self._at(keys, factor)
            hit = own[at] == keys
            out[hit] = table[at[hit]]
        return out


class WordMerges:
    """Merges of a byte-level model with word ends (`</w>`)."""

    def __init__(self, tokenizer: object):
        model = json.loads(tokenizer.to_str())["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([ids[x + y] for x, y in pairs], np.int64)
        key, first = np.unique((a << 16) | b, return_index=True)
        self.rank = _Table(key, first)
        # the usual display of bytes: printable ones as themselves, the others from 256 on in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(shown)]
        sign = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(rest)}
        self.inner = np.array([ids[sign[x]] for x in range(256)], np.int64)
        self.end = np.array([ids[sign[x] + "</w>"] for x in range(256)], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty) end to end, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(size) - 1
        sym[last] = self.end[raw[last]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            joined = np.flatnonzero(word[1:] == word[:-1])
            rank[joined] = self.rank.get((sym[joined] << 16) | sym[joined + 1])
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            over = least == _NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            at = np.flatnonzero((rank == least) & ~over)
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            at = at[first]
            sym[at] = self.merged[rank[at]]
            keep = ~over
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))
