"""Two-stage suffix sorting and common prefixes, as array operations.

Symbols are 0 (a separator) to 256 (byte + 1). Only suffixes smaller than their
successor are sorted directly, by packed words of seven symbols and up to a given
depth; all others are induced by one pass over the 257 buckets in ascending
order: whatever stands in a bucket tells, in its order, the next suffixes of the
buckets of the preceding symbols.
"""

from __future__ import annotations

import numpy as np

PER_WORD, SYMBOL_BITS = 7, 9


def pack(symbols: np.ndarray) -> np.ndarray:
    """The seven symbols from each place on, in one word; beyond the end lie zeros."""
    n = len(symbols)
    wide = np.zeros(n + PER_WORD, np.uint64)
    wide[:n] = symbols
    words = np.zeros(n, np.uint64)
    for j in range(PER_WORD):
        words = words << np.uint64(SYMBOL_BITS) | wide[j : j + n]
    return words


def _word(words: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    place = at + step * PER_WORD
    return np.where(place < len(words), words[np.minimum(place, len(words) - 1)], np.uint64(0))


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(symbols)
    change = np.flatnonzero(symbols[:-1] != symbols[1:])
    up = np.zeros(n, bool)
    if len(change):
        nearest = np.searchsorted(change, np.arange(n))
        inside = nearest < len(change)
        at = change[nearest[inside]]
        up[inside] = symbols[at] < symbols[at + 1]
    return up


def suffix_array(symbols: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in order, exact up to ``depth`` symbols."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_next(symbols)
    order = _sorted_directly(np.flatnonzero(direct), words, depth)
    of = symbols[order]
    first = np.searchsorted(of, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[int(symbols[-1])].append(np.array([n - 1]))  # the predecessor of the empty suffix
    out = []
    for symbol in range(257):
        induced = waiting[symbol]
        # predecessors with the same symbol follow in the same part, run after run
        new = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        parts = []
        while len(new):
            parts.append(new)
            before = new[new > 0] - 1
            new = before[symbols[before] == symbol]
        part = np.concatenate([*parts, order[first[symbol] : first[symbol + 1]]])
        if not len(part):
            continue
        out.append(part)
        before = part[part > 0] - 1
        before = before[symbols[before] > symbol]
        if len(before):
            by = np.argsort(symbols[before], kind="stable")
            before = before[by]
            marks = symbols[before]
            cuts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(before)]):
                waiting[int(marks[a])].append(before[a:b])
        waiting[symbol] = []
    return np.concatenate(out)


def _sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order: word after word, each time only where the ones before tie."""
    order = at[np.argsort(words[at], kind="stable")] if len(at) else at
    if len(order) < 2:
        return order
    key = words[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    for step in range(1, -(-depth // PER_WORD)):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = _word(words, order[where], step)
        by = np.lexsort((key, group[where]))
        order[where] = order[where][by]
        key, old = key[by], group[where]
        new = np.r_[True, (key[1:] != key[:-1]) | (old[1:] != old[:-1])]
        step_up = np.zeros(len(order), np.int64)
        step_up[where] = new & np.r_[False, old[1:] == old[:-1]]
        group = group + np.cumsum(step_up)
    return order


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Symbols each suffix shares with the one before it in order, ``most`` at most; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for step in range(-(-most // PER_WORD)):
        if not len(alive):
            break
        gap = _word(words, order[alive], step) ^ _word(words, order[alive - 1], step)
        equal = gap == 0
        shared[alive[equal]] += PER_WORD
        rest, gap = alive[~equal], gap[~equal]
        # symbols above the highest differing bit
        for j in range(1, PER_WORD):
            shared[rest] += (gap >> np.uint64(SYMBOL_BITS * (PER_WORD - j))) == 0
        alive = alive[equal]
    return np.minimum(shared, most)
