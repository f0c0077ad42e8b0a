"""A compressed trie over globally ordered sets, and an exact similarity join within it.

Sets are sorted arrays of tokens in one global order. The trie keeps runs of tokens shared by
several sets once, in nodes of at most STEP tokens. A probe walks it level by level, carrying
the overlap of each path, and leaves a subtree as soon as the overlap plus the tokens that can
still follow (on either side) is too small for every set below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 64


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m tokens for 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


@dataclass
class Trie:
    """Nodes in order of level. Leaves of a node are first..end in the order of the sorted sets."""

    order: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    start: np.ndarray
    length: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    least: np.ndarray
    most: np.ndarray
    first: np.ndarray
    end: np.ndarray
    levels: list[tuple[int, int]]

    @staticmethod
    def build(sets: list[np.ndarray]) -> Trie:
        """sets: sorted int64 arrays of at least one token each."""
        keys = [s.astype(">i8").tobytes() for s in sets]
        order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        held = [sets[i] for i in order]
        size = np.array([len(s) for s in held], np.int64)
        lcp = np.zeros(len(held) + 1, np.int64)
        for i in range(1, len(held)):
            n = min(size[i - 1], size[i])
            unequal = np.flatnonzero(held[i - 1][:n] != held[i][:n])
            lcp[i] = unequal[0] if len(unequal) else n
        rows, parts = [], []
        level = [(0, len(held), 0, -1)]  # first set, end, tokens before, parent node
        levels = []
        while level:
            begin, following = len(rows), []
            for a, b, depth, parent in level:
                cuts = [a, *(a + 1 + np.flatnonzero(lcp[a + 1 : b] <= depth)).tolist(), b]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if size[i] == depth:  # sets that end here (equal ones, sorted first) are leaves of the parent
                        i += int(np.argmax(size[i:j] > depth)) if (size[i:j] > depth).any() else j - i
                        if i == j:
                            continue
                    until = int(min(lcp[i + 1 : j].min() if j > i + 1 else size[i], size[i], depth + STEP))
                    rows.append((until - depth, parent, until, size[i:j].min(), size[i:j].max(), i, j))
                    parts.append(held[i][depth:until])
                    if size[i:j].max() > until:
                        following.append((i, j, until, len(rows) - 1))
            levels.append((begin, len(rows)))
            level = following
        cols = np.array(rows, np.int64).reshape(-1, 7).T
        start = np.concatenate([[0], np.cumsum(cols[0])])[:-1]
        return Trie(order, size, np.concatenate([np.zeros(0, np.int64), *parts]), start, *cols, [x for x in levels if x[0] < x[1]])

    def __post_init__(self) -> None:
        self.vocabulary, self.codes = np.unique(self.tokens, return_inverse=True)
        self.mark = np.zeros(len(self.vocabulary), np.int64)

    def overlaps(self, probe: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(overlap, bound) with every set in the order given to build(): the overlap where the walk
        reached the set's end, else -1 and an upper bound."""
        at = np.searchsorted(self.vocabulary, probe)
        at = at[(at < len(self.vocabulary))]
        at = at[np.isin(self.vocabulary[at], probe, assume_unique=False)]
        self.mark[at] = 1
        n = len(probe)
        got = np.full(len(self.length), -1, np.int64)
        exact, bound = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        for begin, end in self.levels:
            up = self.parent[begin:end]
            alive = begin + np.flatnonzero((up < 0) | (got[up] >= 0))
            if not len(alive):
                break
            length = self.length[alive]
            offset = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(offset[-1]) + np.repeat(self.start[alive] - offset[:-1], length)
            run = np.concatenate([[0], np.cumsum(self.mark[self.codes[place]])])
            above = self.parent[alive]
            over = run[offset[1:]] - run[offset[:-1]] + np.where(above < 0, 0, got[above])
            best = np.minimum(over + self.most[alive] - self.depth[alive], n)
            keep = best >= needed(n, self.least[alive], percent)
            got[alive[keep]] = over[keep]
            for k in np.flatnonzero(~keep):
                i, j = self.first[alive[k]], self.end[alive[k]]
                exact[i:j], bound[i:j] = -1, best[k]
            for k in np.flatnonzero(keep & (self.least[alive] == self.depth[alive])):
                i, j, d = self.first[alive[k]], self.end[alive[k]], self.depth[alive[k]]
                done = i + np.flatnonzero(self.size[i:j] == d)
                exact[done] = bound[done] = over[k]
        self.mark[at] = 0
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        return exact[back], bound[back]


class Components:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        old = np.unique(np.append(self.label[others], self.label[i]))
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]


def join(sets: list[np.ndarray], percent: int, pivot: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of the links among the sets, and bounds on every set's Jaccard distance from the pivot.

    A set must probe the trie only if some set of another component could be linked with it.
    Jaccard distance is a metric: sets whose distances from an earlier probe differ by more than
    1 - percent/100 are not linked, nor are sets of too different sizes.
    """
    g = len(sets)
    trie, found = Trie.build(sets), Components(g)
    size = np.array([len(s) for s in sets], np.int64)
    low, high = [], []
    limit = 1 - percent / 100 + 1e-9
    todo = np.ones(g, bool)
    turn = [pivot, *(i for i in range(g) if i != pivot)]
    fits = lambda i: (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
    for i in turn:
        if not todo[i]:
            continue
        if low:
            maybe = fits(i) & (found.label != found.label[i])
            for lo, hi in zip(low, high, strict=True):
                maybe &= (lo - hi[i] <= limit) & (lo[i] - hi <= limit)
                if not maybe.any():
                    break
            if not maybe.any():
                continue
        exact, bound = trie.overlaps(sets[i], percent)
        union = size + size[i]
        linked = (exact >= 0) & (exact >= needed(size, size[i], percent))
        found.join(i, np.flatnonzero(linked))
        low.append(1 - bound / (union - bound))
        high.append(np.where(exact >= 0, low[-1], 1.0))
        todo[i] = False
        if (found.label == found.label[0]).all():
            break
    return found.label, low[0], high[0]
