"""LZW over rows of (column, value) pairs. One dictionary for a batch; matches stay within a row."""

from __future__ import annotations

import numpy as np


def encode_ids(ids: np.ndarray, sizes: np.ndarray, initial: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of rows of so many initial pairs each, end to end, the number of codes of each row, and the number of nodes."""
    longer: dict[int, int] = {}
    nodes, codes, counts, at = initial, [], [], 0
    pairs = ids.tolist()
    for size in sizes.tolist():
        before = len(codes)
        if size:
            match = pairs[at]
            for pair in pairs[at + 1 : at + size]:
                key = match * initial + pair
                grown = longer.get(key)
                if grown is None:
                    codes.append(match)
                    longer[key] = nodes
                    nodes += 1
                    match = pair
                else:
                    match = grown
            codes.append(match)
            at += size
        counts.append(len(codes) - before)
    return np.array(codes, np.int64), np.array(counts, np.int64), nodes


def encode(rows: list[list[tuple[int, float]]]) -> tuple[list[tuple[int, float]], list[list[int]], int]:
    """Initial pairs in order of first appearance, the codes of each row, and the number of nodes."""
    number: dict[tuple[int, float], int] = {}
    ids = [number.setdefault((int(c), float(v)), len(number)) for row in rows for c, v in row]
    codes, counts, nodes = encode_ids(np.array(ids, np.int64), np.array([len(r) for r in rows], np.int64), len(number))
    return list(number), [x.tolist() for x in np.split(codes, np.cumsum(counts)[:-1])] if len(counts) else [], nodes


class Nodes:
    """The dictionary rebuilt from codes alone: for each node its parent and its last initial pair, without unfolding rows.

    Every code but the last of a row made one node: its parent is the code, its last pair the first pair of the
    code that follows. First pairs are found by jumping along parents.
    """

    def __init__(self, initial: int, flat: np.ndarray, sizes: np.ndarray):
        ends = np.zeros(len(flat), bool)
        ends[(np.cumsum(sizes) - 1)[sizes > 0]] = True
        grown = np.flatnonzero(~ends)
        self.initial, self.flat, self.sizes = initial, flat, sizes
        self.parent = np.concatenate([np.full(initial, -1), flat[grown]])
        count = len(self.parent)
        first = np.where(self.parent < 0, np.arange(count), self.parent)
        while not np.array_equal(jump := first[first], first):
            first = jump
        following = flat[grown + 1] if len(grown) else grown
        if len(following) and (following >= initial + np.arange(len(grown))).any():
            raise ValueError("a code names a node not yet made: columns of a row must ascend")
        self.last = np.concatenate([np.arange(initial), first[following]]).astype(np.int64)
        self.depth = np.zeros(count, np.int64)
        at = self.parent.copy()
        while (deep := at >= 0).any():
            self.depth[deep] += 1
            at[deep] = self.parent[at[deep]]
        order = np.argsort(self.depth, kind="stable")
        self.levels = [x for x in np.split(order, np.cumsum(np.bincount(self.depth, minlength=1))[:-1])] if count else []
        self.row = np.repeat(np.arange(len(sizes)), sizes)

    def down(self, per_pair: np.ndarray) -> np.ndarray:
        """For each node, the sum of per_pair over its pairs: its parent's sum and its last pair."""
        out = np.zeros((len(self.parent), *per_pair.shape[1:]))
        out[: self.initial] = per_pair
        for level in self.levels[1:]:
            out[level] = out[self.parent[level]] + per_pair[self.last[level]]
        return out

    def up(self, per_node: np.ndarray) -> np.ndarray:
        """The adjoint of `down`: what nodes hold, pushed to their parents and last pairs."""
        held = per_node.copy()
        for level in self.levels[:0:-1]:
            np.add.at(held, self.last[level], held[level])
            np.add.at(held, self.parent[level], held[level])
        return held[: self.initial]

    def unfold(self) -> list[list[int]]:
        """For each row, its initial pairs in order."""
        paths: dict[int, list[int]] = {}

        def path(n: int) -> list[int]:
            if n not in paths:
                paths[n] = [n] if self.parent[n] < 0 else [*path(int(self.parent[n])), int(self.last[n])]
            return paths[n]

        start = np.cumsum(self.sizes) - self.sizes
        return [[p for code in self.flat[a : a + n] for p in path(int(code))] for a, n in zip(start, self.sizes)]


def decode(pairs: list[tuple[int, float]], codes: list[list[int]]) -> list[list[tuple[int, float]]]:
    """The rows that were encoded."""
    flat = np.array([c for row in codes for c in row], np.int64)
    nodes = Nodes(len(pairs), flat, np.array([len(r) for r in codes], np.int64))
    return [[pairs[i] for i in row] for row in nodes.unfold()]
