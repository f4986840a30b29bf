"""Repeated strings of a block, by interval expansion on its Burrows-Wheeler transform.

Each string of length m is an interval of the sorted suffixes. Backward extension turns the
intervals of all strings of length m that end a run of equal prefixes into those of length
m + 1, breadth first. An extension that reaches a boundary between neighbouring suffixes for
the first time sets their common prefix to m, so common prefixes come by increasing value. The
expansion stops at the minimum length: boundaries not reached by then are between suffixes that
share at least so much, which is all that is asked, and no longer prefix is ever computed.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a block: three ranks fit into one sorting key.
BLOCK = (1 << 21) - 1
SYMBOL_BITS = 9
KEY_SYMBOLS = 7


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, and the sorted 7-symbol keys.

    Ranks by 7 symbols are made threefold longer with each sort.
    """
    n = len(text)
    if n > BLOCK:
        raise ValueError(f"{n} symbols exceed a block of {BLOCK}")
    padded = np.zeros(n + KEY_SYMBOLS, np.uint64)
    padded[:n] = text
    key = padded[:n].copy()
    for i in range(1, KEY_SYMBOLS):
        key = key << np.uint64(SYMBOL_BITS) | padded[i : i + n]
    order = np.argsort(key)
    firsts = key[order]
    known = KEY_SYMBOLS
    changed = firsts[1:] != firsts[:-1]
    while known < depth and not changed.all():
        rank = np.zeros(n + 2 * known, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], changed])).astype(np.uint64)
        key = rank[:n] << np.uint64(42) | rank[known : n + known] << np.uint64(21) | rank[2 * known : n + 2 * known]
        order = np.argsort(key)
        ordered = key[order]
        changed = ordered[1:] != ordered[:-1]
        known *= 3
    return order, firsts


def shares_prefix(text: np.ndarray, minimum: int) -> np.ndarray:
    """Which suffixes share their first ``minimum`` symbols, at least 7, with another one.

    ``text`` holds symbols from 1 to 511. A match may run over any symbol.
    """
    n = len(text) + 1
    symbols = np.zeros(n, np.uint64)
    symbols[:-1] = text
    order, firsts = suffix_order(symbols, minimum)
    before = symbols[order - 1].astype(np.int64)  # the transform; what stands before the start is the end
    by_symbol = np.argsort(before, kind="stable")
    extended = np.empty(n, np.int64)
    extended[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following = np.full(n, n, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    places = before[by_symbol] * n + by_symbol

    # Common prefixes under 7 show in the keys. Boundaries: set[i] is between suffixes i - 1 and i.
    differ = np.zeros(n + 1, np.uint64)
    differ[1:n] = firsts[1:] ^ firsts[:-1]
    differ[[0, n]] = 1 << 62
    known = differ > 0
    edges = np.flatnonzero(known)
    ends = differ < 1 << SYMBOL_BITS
    picked = ends[edges[1:]]
    start, stop = edges[:-1][picked], edges[1:][picked]
    for _ in range(KEY_SYMBOLS, minimum):
        if not len(start):
            break
        sizes = stop - start
        one = sizes == 1
        lone = extended[start[one]]
        lone = lone[~known[lone + 1]]
        known[lone + 1] = True
        start, stop, sizes = start[~one], stop[~one], sizes[~one]
        within = np.repeat(stop - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        last = following[within] >= np.repeat(stop, sizes)
        within = within[last]
        reached = extended[within] + 1
        new = ~known[reached]
        reached, within = reached[new], within[new]
        known[reached] = True
        origin = np.repeat(start, sizes)[last][new]
        lowest = np.searchsorted(places, before[within] * n + origin)
        start, stop = np.concatenate([lone, lowest]), np.concatenate([lone + 1, reached])
    shared = ~known
    out = np.zeros(n, bool)
    out[order] = shared[:-1] | shared[1:]
    return out[:-1]
