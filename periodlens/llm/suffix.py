"""Suffix order of many short texts by two-stage sorting, in numpy.

Suffixes that are smaller than their successor (the suffix one byte on) are
sorted directly; the others are induced by one scan over the buckets of first
bytes in rising order: each scanned suffix puts its predecessor, if that is a
larger one, next into the bucket of its own first byte.  Adjacent common
prefixes then tell which texts share a string.
"""

from __future__ import annotations

import numpy as np

SYMBOL_BITS = 9  # a byte plus one, and zero for the end of a text
PER_WORD = 7


def packed(symbols: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` symbols (at least) from each place as 63-bit numbers of seven symbols, in rising order of place.
    Places near the end read zeros."""
    padded = np.concatenate([symbols, np.zeros(length + 2 * PER_WORD, symbols.dtype)]).astype(np.uint64)
    bits = np.uint64(SYMBOL_BITS)
    two = padded[:-1] << bits | padded[1:]
    four = two[:-2] << bits * np.uint64(2) | two[2:]
    seven = four[:-3] << bits * np.uint64(3) | two[4 : 4 + len(four) - 3] << bits | padded[6 : 6 + len(four) - 3]
    return [seven[at + k] for k in range(0, length, PER_WORD)]


def smaller_than_successor(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts one symbol on; ends of texts (0) are."""
    n = len(symbols)
    up = np.zeros(n, bool)
    up[:-1] = symbols[:-1] < symbols[1:]
    equal = np.zeros(n, bool)
    equal[:-1] = symbols[:-1] == symbols[1:]
    decided = np.where(equal, n - 1, np.arange(n))  # a run of equal symbols goes by what follows it
    at = np.minimum.accumulate(decided[::-1])[::-1]
    return up[at] | (symbols == 0)


def suffix_order(symbols: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places in the order of their suffixes, exact to ``depth`` symbols.

    Every text in ``symbols`` ends in 0.  Only what the wanted places need is
    sorted: they themselves and, after each, the places up to the next suffix
    that is smaller than its successor.
    """
    n = len(symbols)
    small = smaller_than_successor(symbols)
    need = wanted.copy()
    # a larger suffix is induced from its successor: spread need to the right through larger ones
    last_small = np.maximum.accumulate(np.where(small, np.arange(n), -1))
    last_wanted = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))
    before = np.concatenate([[-1], last_small[:-1]])
    need |= (last_wanted >= 0) & (last_wanted > before)  # no smaller suffix from the wanted place up to the one before here
    direct = np.flatnonzero(need & small)
    words = packed(symbols, direct, depth)
    direct = direct[np.lexsort(words[::-1])]
    first = symbols[direct]
    cuts = np.searchsorted(first, np.arange(int(symbols.max()) + 2 if n else 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(len(cuts))]
    large = need & ~small
    order = []
    for c in range(len(cuts) - 1):
        parts = []
        frontier = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(frontier):  # runs of one symbol induce themselves
            parts.append(frontier)
            back = frontier[frontier > 0] - 1
            frontier = back[large[back] & (symbols[back] == c)]
        parts.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(parts)
        if len(whole):
            order.append(whole)
            back = whole[whole > 0] - 1
            back = back[large[back] & (symbols[back] > c)]
            if len(back):
                to = symbols[back]
                by = np.argsort(to, kind="stable")
                back, to = back[by], to[by]
                new = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(to)]):
                    induced[int(to[a])].append(back[a:b])
    out = np.concatenate(order) if order else direct
    return out[wanted[out]]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, ``depth`` at most, of the prefix that each suffix in order shares with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    differ = np.zeros(len(same), np.uint64)
    base = np.zeros(len(same), np.int64)
    for k, word in enumerate(packed(symbols, order, depth)):
        x = word[1:] ^ word[:-1]
        here = same & (x != 0)
        differ[here], base[here] = x[here], k * PER_WORD
        same &= x == 0
    lead = np.zeros(len(same), np.int64)
    open_ = np.ones(len(same), bool)
    for k in range(PER_WORD):
        open_ &= differ >> np.uint64(SYMBOL_BITS * (PER_WORD - 1 - k)) == 0
        lead += open_
    if len(order):
        out[1:] = np.minimum(np.where(same, depth, base + lead), depth)
    return out


def least_of_equal(data: np.ndarray, lengths: np.ndarray, own: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Texts end to end in ``data`` (bytes, ``lengths``): for the first ``own`` places of each text, in order, the
    least of the ``ids`` of all texts in whose first places the same ``depth`` bytes start."""
    total, texts = int(lengths.sum()), len(lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    symbols = np.zeros(total + texts, np.int16)
    place = np.arange(total) + np.repeat(np.arange(texts), lengths)
    symbols[place] = data.astype(np.int16) + 1
    own_place = np.repeat(start + np.arange(texts), own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    wanted = np.zeros(len(symbols), bool)
    wanted[own_place] = True
    order = suffix_order(symbols, wanted, depth)
    new = np.flatnonzero(common_prefixes(symbols, order, depth) < depth)
    number = np.empty(len(symbols), np.int64)
    number[own_place] = np.repeat(np.arange(texts), own)
    of_order = ids[number[order]]
    least = np.minimum.reduceat(of_order, new) if len(new) else of_order
    number[order] = np.repeat(least, np.diff(np.append(new, len(order))))
    return number[own_place]
