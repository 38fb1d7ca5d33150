"""External suffix sorting: induction through bucket queues that spill to disk."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

END, GAP, FIRST = 0, 1, 2
SIGMA = 258
SCAN = 1 << 18
_ENTRY = np.dtype([("pos", np.int64), ("lcp", np.uint8)])


class Spill:
    """Keeps blocks in memory up to a budget, and writes the rest to a folder."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.held, self.files = folder, budget, 0, 0

    def put(self, block: np.ndarray):
        if self.held + block.nbytes <= self.budget:
            self.held += block.nbytes
            return block
        path = os.path.join(self.folder, f"{self.files}.npy")
        self.files += 1
        np.save(path, block)
        return path

    @staticmethod
    def get(block) -> np.ndarray:
        return np.load(block) if isinstance(block, str) else block

    def take(self, block) -> np.ndarray:
        """A block that is put elsewhere next."""
        if isinstance(block, str):
            found = np.load(block)
            os.remove(block)
            return found
        self.held -= block.nbytes
        return block


class BucketQueue:
    """A monotone priority queue of suffix tuples keyed by their first symbol.

    Symbols are taken in one direction only, and within one the tuples in the order
    of their arrival, which induction makes their sorted order. ``near`` holds, per
    symbol, the smallest common prefix met since its last tuple was induced.
    """

    def __init__(self, spill: Spill, cap: int):
        self.spill, self.cap = spill, cap
        self.blocks: list[list] = [[] for _ in range(SIGMA)]
        self.near = np.full(SIGMA, 255, np.uint8)

    def push(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Add tuples that are grouped by symbol."""
        bounds = np.searchsorted(symbol, np.arange(SIGMA + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            block = np.empty(bounds[c + 1] - bounds[c], _ENTRY)
            block["pos"], block["lcp"] = pos[bounds[c] : bounds[c + 1]], lcp[bounds[c] : bounds[c + 1]]
            if not self.blocks[c]:
                block["lcp"][0] = 0
            self.blocks[c].append(self.spill.put(block))

    def scan(self, c: int) -> Iterator[np.ndarray]:
        """The tuples of a symbol, also those that arrive meanwhile; small blocks that
        wait together become one."""
        at, blocks = 0, self.blocks[c]
        while at < len(blocks):
            stop, taken, size = at, [], 0
            while stop < len(blocks) and size < SCAN:
                taken.append(self.spill.take(blocks[stop]))
                size += len(taken[-1])
                stop += 1
            block = np.concatenate(taken)
            blocks[at:stop] = [self.spill.put(block)]
            yield block
            at += 1

    def induce(self, text: np.ndarray, wanted: np.ndarray, value: bool, block: np.ndarray) -> None:
        """Push the left neighbours of scanned suffixes whose type is ``value``.

        The common prefix of two neighbours in a bucket is one more than the smallest
        met between their right neighbours.
        """
        lcp = block["lcp"]
        prev = block["pos"] - 1
        idx = np.flatnonzero(prev >= 0)
        idx = idx[wanted[prev[idx]] == value]
        symbol = text[prev[idx]]
        order = np.argsort(symbol, kind="stable")
        idx, symbol = idx[order], symbol[order].astype(np.int64)
        least = lcp.min()
        if len(idx) == 0:
            np.minimum(self.near, least, out=self.near)
            return
        first = np.ones(len(idx), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        found = np.empty(len(idx), np.uint8)
        prefix = np.minimum.accumulate(lcp)
        found[first] = np.minimum(self.near[symbol[first]], prefix[idx[first]])
        rest = np.flatnonzero(~first)
        found[rest] = _range_min(lcp, idx[rest - 1] + 1, idx[rest])
        suffix = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        last = np.append(np.flatnonzero(first)[1:] - 1, len(idx) - 1)
        np.minimum(self.near, least, out=self.near)
        self.near[symbol[last]] = suffix[idx[last] + 1]
        longer = np.minimum(found.astype(np.int64) + 1, self.cap).astype(np.uint8)
        self.push(symbol, prev[idx], longer)


def _range_min(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of ``values[left..right]``, both ends included."""
    out = np.empty(len(left), values.dtype)
    width = (right - left + 1).astype(np.int64)
    level = np.frexp(width.astype(float))[1] - 1
    table, size = values, 1
    for step in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == step)
        out[here] = np.minimum(table[left[here]], table[right[here] - size + 1])
        table = np.minimum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2
    return out


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(len(text), bool)
    small[:-1] = np.append(step, 1)[at] > 0
    return small


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, size: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of suffix pairs, at most ``cap`` or ``size``."""
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for k in range(cap):
        x, y = a[active] + k, b[active] + k
        inside = (x < len(text)) & (y < len(text))
        if size is not None:
            inside &= size[active] > k
        active, x, y = active[inside], x[inside], y[inside]
        same = text[x] == text[y]
        active = active[same]
        if not len(active):
            break
        out[active] = k + 1
    return out


class SuffixSorter:
    """Sorts the suffixes of a text by their first ``cap`` symbols, with common prefixes.

    The text ends with ``END``. Left-most small suffixes are sorted by their pieces,
    the pieces named, the shorter sequence of names sorted in turn, and from these
    suffixes all others are induced: larger ones upwards, smaller ones downwards.
    Suffix tuples wait in bucket queues, of which only ``budget`` bytes stay in memory.
    """

    def __init__(self, text: np.ndarray, cap: int, folder: str, budget: int = 64 << 20, block: int = 1 << 19):
        self.text, self.cap, self.folder, self.budget, self.block = text, cap, folder, budget, block
        self.small = types(text)
        start = self.small.copy()
        start[0] = False
        start[1:] &= ~self.small[:-1]
        self.seeds = np.flatnonzero(start)

    def _induced(self, seeds: np.ndarray, lcp: np.ndarray) -> tuple[BucketQueue, BucketQueue]:
        """Queues of the larger suffixes, ascending, and of the smaller ones, descending."""
        text = self.text
        spill = Spill(tempfile.mkdtemp(dir=self.folder), self.budget)
        given, large, small = (BucketQueue(spill, self.cap) for _ in range(3))
        for s in range(0, len(seeds), self.block):
            part = seeds[s : s + self.block]
            order = np.argsort(text[part], kind="stable")
            given.push(text[part][order], part[order], lcp[s : s + self.block][order])
        for c in range(SIGMA):
            last = None
            for block in large.scan(c):
                large.induce(text, self.small, False, block)
                last = block["pos"][-1]
            for n, block in enumerate(given.scan(c)):
                block = block.copy()
                if n == 0 and last is not None:
                    block["lcp"][0] = self._pair(last, block["pos"][0])
                large.induce(text, self.small, False, block)
        for c in range(SIGMA - 1, -1, -1):
            last = None
            for block in small.scan(c):
                small.induce(text, self.small, True, block)
                last = block["pos"][-1]
            above = 0
            for n, block in enumerate(reversed(large.blocks[c])):
                block = Spill.get(block)
                down = block[::-1].copy()
                if n == 0 and last is not None:
                    above = self._pair(last, down["pos"][0])
                down["lcp"][1:], after = down["lcp"][:-1].copy(), down["lcp"][-1]
                down["lcp"][0] = above
                above = after
                small.induce(text, self.small, True, down)
        return large, small

    def _pair(self, a: int, b: int) -> int:
        return int(common(self.text, np.array([a]), np.array([b]), self.cap)[0])

    def _ordered_seeds(self) -> np.ndarray:
        seeds = self.seeds
        if len(seeds) < 2:
            return seeds
        _, small = self._induced(seeds, np.zeros(len(seeds), np.uint8))
        is_seed = np.zeros(len(self.text), bool)
        is_seed[seeds] = True
        found = []
        for c in range(SIGMA):
            for block in reversed(small.blocks[c]):
                pos = Spill.get(block)["pos"][::-1]
                found.append(pos[is_seed[pos]])
        shutil.rmtree(small.spill.folder)
        pieces = np.concatenate([seeds[-1:], *found]) if is_seed[len(self.text) - 1] else np.concatenate(found)
        rank_of = np.searchsorted(seeds, pieces)
        size = np.diff(np.append(seeds, len(self.text) - 1)) + 1
        mine = size[rank_of]
        limit = np.minimum(mine, self.cap)
        same = common(self.text, pieces[:-1], pieces[1:], self.cap, limit[:-1]) == limit[:-1]
        same &= (mine[:-1] == mine[1:]) | ((mine[:-1] >= self.cap) & (mine[1:] >= self.cap))
        name = np.empty(len(seeds), np.int64)
        name[rank_of] = np.concatenate([[0], np.cumsum(~same)])
        return seeds[self._sorted_names(name)]

    def _sorted_names(self, name: np.ndarray) -> np.ndarray:
        """Order of the suffixes of the named sequence: pairs of names are named again,
        each round doubling what a name stands for, until it covers ``cap`` symbols."""
        reach = 1
        while reach < self.cap and name.max() + 1 < len(name):
            after = np.zeros(len(name), np.int64)
            after[:-reach] = name[reach:] + 1
            _, name = np.unique(name * (len(name) + 1) + after, return_inverse=True)
            reach *= 2
        return np.argsort(name, kind="stable")

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in sorted order, with each one's common prefix with the one before."""
        seeds = self._ordered_seeds()
        lcp = np.zeros(len(seeds), np.uint8)
        lcp[1:] = common(self.text, seeds[:-1], seeds[1:], self.cap)
        large, small = self._induced(seeds, lcp)
        for c in range(FIRST, SIGMA):
            last = None
            for block in large.scan(c):
                yield block["pos"], block["lcp"]
                last = block["pos"][-1]
            below = None
            for block in reversed(small.blocks[c]):
                up = Spill.get(block)[::-1]
                common_before = np.empty(len(up), np.uint8)
                common_before[1:] = up["lcp"][:-1]
                common_before[0] = below if below is not None else (0 if last is None else self._pair(last, up["pos"][0]))
                below = up["lcp"][-1]
                yield up["pos"], common_before


def repeated_positions(pieces: Iterator[np.ndarray], cap: int, folder: str, budget: int = 64 << 20) -> np.ndarray:
    """Places, counted over all bytes of ``pieces``, of the ``cap``-byte strings that
    start at an earlier place too; strings lie within one piece. Ascending."""
    path, sizes = os.path.join(folder, "text"), []
    with open(path, "wb") as out:
        for piece in pieces:
            coded = piece.astype("<u2") + FIRST
            out.write(np.append(coded, np.uint16(GAP)).astype("<u2").tobytes())
            sizes.append(len(piece))
        out.write(np.array([END], "<u2").tobytes())
    sizes = np.array(sizes, np.int64)
    if not len(sizes):
        return sizes
    text = np.memmap(path, dtype="<u2", mode="r")
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    gone = np.zeros(len(text), bool)
    held, first = 0, 0
    for pos, lcp in SuffixSorter(text, cap, folder, budget).blocks():
        new = np.flatnonzero(lcp < cap)
        cuts = np.concatenate([[0], new]) if not len(new) or new[0] else new
        lows = np.minimum.reduceat(pos, cuts)
        counts = np.diff(np.append(cuts, len(pos)))
        if lcp[0] >= cap and held:
            lows[0] = min(lows[0], first)
            gone[first] = True
        many = np.repeat(counts > 1, counts)
        gone[pos[many]] = True
        if lcp[0] >= cap and held:
            gone[pos[: counts[0]]] = True
            counts[0] += held
        gone[lows[counts > 1]] = False
        held, first = counts[-1], lows[-1]
    found = np.flatnonzero(gone)
    of = np.searchsorted(starts, found, side="right") - 1
    inside = found - starts[of] + cap <= sizes[of]
    return (found - of)[inside]
