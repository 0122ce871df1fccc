"""Chains of hits along both sides of a chromosome pair, one after the other by score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: The least hits of a chain.
KEEP_BEST = 3
#: Pairs of hits that are listed; beyond, a hit looks up its predecessors each time.
LISTED = 5_000_000


def reachable(x: np.ndarray, y: np.ndarray, far: tuple[int, int]) -> tuple[np.ndarray, np.ndarray] | None:
    """(hit, earlier hit) for hits in order of ``y``, by hit, earlier ones first: the pairs within ``far`` on both sides
    between which no third hit lies, in order and along x; None if there are more than LISTED.

    A hit between two splits their way, and whole parts of the two ways are no more than those of the whole; so the way
    over it scores one more at least, and the pair is no step of any chain while that hit is free."""
    n = len(x)
    at = np.arange(n)
    first = np.searchsorted(y, y - far[1], side="left")
    own, low, high = x.copy(), x - far[0] - 1, x + far[0] + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total, d = 0, 0
    while True:
        d += 1
        keep = (at - d >= first) & ((low < own) | (high > own))
        if not keep.all():
            at, first, own, low, high = (c[keep] for c in (at, first, own, low, high))
        if not len(at):
            break
        seen = x[at - d]
        left, right = (seen <= own) & (seen > low), (seen >= own) & (seen < high)
        np.copyto(low, seen, where=left)
        np.copyto(high, seen, where=right)
        some = at[left | right]
        total += len(some)
        if total > LISTED:
            return None
        if len(some):
            found.append((some, some - d))
    to, before = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((before, to))
    return to[order], before[order]


class ChainSearch:
    """Chains over hits in order of ``y``: a hit scores 1 + its predecessor's score - int(dx/gap1 + dy/gap2), over free
    hits before it within the greatest gaps ``far``; of equal predecessors the nearest, of equal ends the
    longer chain, then the earlier end. A chain's hits are free no more for the chains after it.

    Pairs that may be steps are found once for what is free, for all gaps. When a chain is taken, scores only fall, so a
    hit is scored again only if its own predecessor went or fell; it then looks through the cells of a grid, as wide as
    the reach, from which a chain's hits go when it is taken. Ends wait in a heap."""

    def __init__(self, x: np.ndarray, y: np.ndarray, far: tuple[int, int]) -> None:
        self.x, self.y, self.far, self.n = x.astype(np.int64), y.astype(np.int64), far, len(x)
        self.free: np.ndarray | None = None
        self.xs, self.ys = self.x.tolist(), self.y.tolist()
        wide = [max(1, g) for g in far]
        self.cell = list(zip((self.x // wide[0]).tolist(), (self.y // wide[1]).tolist(), strict=True))

    def _look(self, free: np.ndarray) -> None:
        """Lists the pairs and fills the grid with what is free, if that is not what it was."""
        if self.free is not None and np.array_equal(free, self.free):
            return
        self.free = free.copy()
        some = np.flatnonzero(free)
        self.pairs = reachable(self.x[some], self.y[some], self.far)
        if self.pairs is not None:
            to, before = (some[c] for c in self.pairs)
            self.dx, self.dy = np.abs(self.x[to] - self.x[before]), self.y[to] - self.y[before]
            self.off = np.searchsorted(to, np.arange(self.n + 1)).tolist()
            self.before = before.tolist()
        self.grid: dict[tuple[int, int], list[int]] = {}
        for i in some.tolist():
            self.grid.setdefault(self.cell[i], []).append(i)

    def chains(self, free: np.ndarray, gap: tuple[int, int]) -> Iterator[list[int]]:
        """All chains of KEEP_BEST hits and more, best first, until the best one is shorter."""
        self._look(free)
        g1, g2 = max(1, gap[0]), max(1, gap[1])
        far1, far2 = self.far
        n, xs, ys, cell, pairs = self.n, self.xs, self.ys, self.cell, self.pairs
        before, off, grid = (self.before, self.off, self.grid) if pairs is not None else ([], [], self.grid)
        open_ = free.tolist()
        score, count, back = [1] * n, [1] * n, [-1] * n
        after: dict[int, list[int]] = {}
        lost = (self.dx / g1 + self.dy / g2).astype(np.int64).tolist() if pairs is not None else []
        left: dict[tuple[int, int], list[int]] = {}  # cells of the grid without the hits of chains

        def put(i: int, best: int, at: int) -> None:
            if at >= 0:
                score[i], count[i], back[i] = best, count[at] + 1, at
                after.setdefault(at, []).append(i)
            else:
                score[i], count[i], back[i] = 1, 1, -1

        def rate_again(i: int) -> None:
            best, at = 0, -1
            x, y, (cx, cy) = xs[i], ys[i], cell[i]
            for c in ((cx - 1, cy - 1), (cx, cy - 1), (cx + 1, cy - 1), (cx - 1, cy), (cx, cy), (cx + 1, cy)):
                for j in left[c] if c in left else grid.get(c, ()):
                    if j < i and open_[j] and y - ys[j] <= far2 and abs(x - xs[j]) <= far1:
                        value = 1 + score[j] - int(abs(x - xs[j]) / g1 + (y - ys[j]) / g2)
                        if value > 0 and (value > best or (value == best and j > at)):
                            best, at = value, j
            put(i, best, at)

        def followers(i: int) -> list[int]:
            return [j for j in after.get(i, ()) if back[j] == i and open_[j]]

        for i in range(n):
            if open_[i]:
                if pairs is None:
                    rate_again(i)
                    continue
                best, at = 0, -1
                for k in range(off[i], off[i + 1]):
                    j = before[k]
                    if (value := 1 + score[j] - lost[k]) >= best and value > 0:
                        best, at = value, j
                put(i, best, at)
        ends = [(-score[i], -count[i], i) for i in range(n) if back[i] >= 0]
        heapq.heapify(ends)
        while ends:
            s, c, end = heapq.heappop(ends)
            if not open_[end] or back[end] < 0 or (s, c) != (-score[end], -count[end]):
                continue
            if -c < KEEP_BEST:
                return
            chain = [end]
            while back[chain[-1]] >= 0:
                chain.append(back[chain[-1]])
            for i in chain:
                open_[i] = False
            for of in {cell[i] for i in chain}:
                left[of] = [i for i in (left[of] if of in left else grid[of]) if open_[i]]
            stale = {j for i in chain for j in followers(i)}
            queue = sorted(stale)
            while queue:
                i = heapq.heappop(queue)
                old = (score[i], count[i])
                rate_again(i)
                if back[i] >= 0:
                    heapq.heappush(ends, (-score[i], -count[i], i))
                if old != (score[i], count[i]):
                    for j in followers(i):
                        if j not in stale:
                            stale.add(j)
                            heapq.heappush(queue, j)
            yield chain[::-1]


def best_chain(x: np.ndarray, y: np.ndarray, free: np.ndarray, far: tuple[int, int], gap: tuple[int, int]) -> list[int]:
    """The first chain of :class:`ChainSearch`, or none."""
    return next(ChainSearch(x, y, far).chains(free, gap), [])
