"""Byte-pair merging of many pre-tokens at once, in ragged numpy arrays."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Which two adjacent symbols join to which, and how early.

    ``pieces`` maps a piece to its id, ``rank`` gives each id's rank (lower
    merges first; equal ranks merge from the left). Any two pieces whose
    concatenation is a piece may be joined. Looked up through an open-addressed
    hash table, so that whole arrays of pairs are answered at once.
    """

    def __init__(self, pieces: dict[str, int], rank: np.ndarray):
        left, right, made = [], [], []
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        self.rank = rank
        bits = max(10, int(np.ceil(np.log2(max(1, len(made)) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._made = np.zeros(1 << bits, np.int32)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        slots = self._slot(keys)
        made = np.array(made, np.int32)
        left_over = np.arange(len(keys))
        while len(left_over):
            free = left_over[self._keys[slots[left_over]] < 0]
            taken, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self._keys[taken], self._made[taken] = keys[placed], made[placed]
            left_over = np.setdiff1d(left_over, placed, assume_unique=True)
            slots[left_over] = (slots[left_over] + 1) & self._mask
        # A piece is hasty if it can take part in a merge that is not later than
        # its own: then its other occurrences in a sequence must wait.
        self.hasty = np.zeros(len(rank), bool)
        for side in (np.array(left, np.int64), np.array(right, np.int64)):
            if len(side):
                np.logical_or.at(self.hasty, side, rank[made] <= rank[side])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self._shift).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each joined pair, -1 where the two do not join."""
        made = np.full(len(left), -1, np.int32)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[known].astype(np.int64) << 32 | right[known].astype(np.int64)
        slots = self._slot(keys)
        while len(known):
            found = self._keys[slots]
            hit = found == keys
            made[known[hit]] = self._made[slots[hit]]
            on = ~hit & (found >= 0)
            known, keys, slots = known[on], keys[on], (slots[on] + 1) & self._mask
        return made

    def ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], NONE)


def merge_ranked(table: MergeTable, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge every sequence to its end: ``(symbols, first, sizes)`` of what survives.

    ``symbols`` holds the sequences one after another, ``sizes`` their lengths;
    a negative symbol joins with nothing. ``first`` is the place of each
    survivor's first symbol in the input. In each step every sequence applies
    its lowest-ranked pair: at all its places at once from the left without
    overlap, or, for a hasty piece, at its leftmost place only, which is what
    merging one pair at a time would do. Finished sequences leave the arrays.
    """
    n = len(sizes)
    sym = symbols.astype(np.int32)
    seq = np.repeat(np.arange(n, dtype=np.int32), sizes)
    first = np.arange(len(sym), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs_at(where: np.ndarray) -> np.ndarray:
        nxt = np.minimum(where + 1, len(sym) - 1)
        made = table.join(sym[where], sym[nxt])
        made[(seq[nxt] != seq[where]) | (nxt == where)] = -1
        return made

    made = pairs_at(np.arange(len(sym)))
    rank = table.ranks(made)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        spans = np.diff(np.r_[starts, len(sym)])
        live = np.repeat(lowest < NONE, spans)
        if not live.all():
            done.append((seq[~live], sym[~live], first[~live]))
            sym, seq, first, made, rank = sym[live], seq[live], first[live], made[live], rank[live]
            spans, lowest = spans[lowest < NONE], lowest[lowest < NONE]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, spans))
        run = np.r_[True, (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])]
        begins = np.flatnonzero(run)
        within = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        opening = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
        opens = np.flatnonzero(opening)
        # Pieces of one rank may differ: one hasty among them makes all of them wait.
        slow = np.repeat(np.logical_or.reduceat(table.hasty[made[at]], opens), np.diff(np.r_[opens, len(at)]))
        at = at[np.where(slow, opening, within % 2 == 0)]
        sym[at] = made[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        moved = np.cumsum(stay) - 1
        sym, seq, first, made, rank = sym[stay], seq[stay], first[stay], made[stay], rank[stay]
        changed = moved[at]
        before = changed[changed > 0] - 1
        touched = np.zeros(len(sym), bool)
        touched[changed] = touched[before] = True
        again = np.flatnonzero(touched)
        made[again] = pairs_at(again)
        rank[again] = table.ranks(made[again])
    if not done:
        return sym, first, np.zeros(n, np.int64)
    seq, sym, first = (np.concatenate(part) for part in zip(*done, strict=True))
    order = np.argsort(first, kind="stable")
    return sym[order], first[order], np.bincount(seq, minlength=n).astype(np.int64)


def merge_queued(table: MergeTable, symbols: list[int]) -> tuple[list[int], list[int]]:
    """The same for one very long sequence, by a queue of pairs: its time does not grow with the square."""
    n = len(symbols)
    sym, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    left = np.array(symbols, np.int32)
    made = table.join(left[:-1], left[1:]) if n > 1 else np.zeros(0, np.int32)
    queue = [(int(table.rank[m]), i, symbols[i], symbols[i + 1], int(m)) for i, m in enumerate(made.tolist()) if m >= 0]
    heapq.heapify(queue)
    seen: dict[tuple[int, int], int] = {}

    def offer(i: int, j: int) -> None:
        key = (sym[i], sym[j])
        m = seen.get(key)
        if m is None:
            m = seen[key] = int(table.join(np.array([key[0]], np.int32), np.array([key[1]], np.int32))[0])
        if m >= 0:
            heapq.heappush(queue, (int(table.rank[m]), i, *key, m))

    while queue:
        _, i, a, b, m = heapq.heappop(queue)
        if not alive[i] or sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
            continue
        j = nxt[i]
        sym[i], alive[j], nxt[i] = m, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            offer(i, nxt[i])
        if prev[i] >= 0:
            offer(prev[i], i)
    kept = [i for i in range(n) if alive[i]]
    return [sym[i] for i in kept], kept
