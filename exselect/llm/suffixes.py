"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays of one shard."""

from __future__ import annotations

import numpy as np

WIDEST = 1024  # up to this many symbols buckets are walked in waves of arrays, beyond it suffix by suffix


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the only smallest one."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = np.append(s[:-1] < s[1:], True)
    return smaller[following]


def _place(sa: np.ndarray, s: np.ndarray, items: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put items, in order, at the edges of their buckets; edges move by step."""
    if not len(items):
        return
    symbols = s[items]
    order = np.argsort(symbols.astype(np.uint16), kind="stable")  # a radix sort: linear
    symbols, items = symbols[order], items[order]
    starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    counts = np.diff(np.append(starts, len(symbols)))
    inside = np.arange(len(symbols)) - np.repeat(starts, counts)
    if step > 0:
        sa[edge[symbols] + inside] = items
        edge[symbols[starts]] += counts
    else:
        sa[edge[symbols] - 1 - inside] = items
        edge[symbols[starts]] -= counts


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order all suffixes from the leftmost-smaller ones, given in order: larger types to the right, smaller to the left."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(len(s), -1, np.int64)
    groups = np.argsort(s[lms], kind="stable")
    lms, bounds = lms[groups], np.searchsorted(s[lms][groups], np.arange(size + 1))
    head = begins.copy()
    for c in np.flatnonzero(counts):
        done = begins[c]
        while done < head[c]:
            wave, done = sa[done:head[c]], head[c]
            before = wave[wave > 0] - 1
            _place(sa, s, before[~small[before]], head, 1)
        wave = lms[bounds[c]:bounds[c + 1]]
        before = wave[wave > 0] - 1
        _place(sa, s, before[~small[before]], head, 1)
    tail = ends.copy()
    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c]
        while done > tail[c]:
            wave, done = sa[tail[c]:done][::-1], tail[c]
            before = wave[wave > 0] - 1
            _place(sa, s, before[small[before]], tail, -1)
        wave = sa[begins[c]:head[c]][::-1]
        before = wave[wave > 0] - 1
        _place(sa, s, before[small[before]], tail, -1)
    if sa[0] < 0:
        sa[0] = len(s) - 1
    return sa


def _same_as_before(s: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it in the list."""
    same = np.append(False, lengths[1:] == lengths[:-1])
    at, step = np.flatnonzero(same), 0
    while len(at):
        equal = s[starts[at] + step] == s[starts[at - 1] + step]
        same[at[~equal]] = False
        at = at[equal]
        step += 1
        at = at[lengths[at] > step]
    return same


def induce_each(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """As `induce`, one suffix at a time: for alphabets with few suffixes per bucket."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    tail, head = ends.tolist(), (ends - counts).tolist()
    symbols, n = s.tolist(), len(s)
    sa = [-1] * n
    for i in lms[::-1].tolist():
        c = symbols[i]
        tail[c] -= 1
        sa[tail[c]] = i
    # The symbol before each suffix, if it is of the type that is placed; two more for places that are not taken.
    larger = np.append(np.where(small, -1, s), [-1, -1]).tolist()
    for i in sa:  # grows ahead of the loop
        c = larger[i - 1]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    smaller = np.append(np.where(small, s, -1), [-1, -1]).tolist()
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k] - 1
        c = smaller[i]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = i
    sa[0] = len(sa) - 1
    return np.array(sa, np.int64)


def sorted_names(names: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of a string of names, sorted in turn.

    No comparison goes beyond a name that occurs once: of a run of such names only the first is needed after others,
    and all of them have their places by name.
    """
    counts = np.bincount(names, minlength=size)
    once = counts[names] == 1
    keep = ~once
    keep[1:] |= ~once[:-1]
    keep[-1] = True
    kept = np.flatnonzero(keep)
    if len(kept) == len(names):
        return suffix_array(names, size)
    seen = np.zeros(size, np.int64)
    seen[names[kept]] = 1
    dense = np.cumsum(seen) - 1
    several = kept[suffix_array(dense[names[kept]], int(dense[-1]) + 1)]
    out, free = np.empty(len(names), np.int64), np.ones(len(names), bool)
    singles = np.flatnonzero(once)
    place = (np.cumsum(counts) - counts)[names[singles]]
    out[place] = singles
    free[place] = False
    out[free] = several[~once[several]]
    return out


def named_by_symbols(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in order of symbols and types, a few symbols at a time, and their number.

    Only substrings that still equal others are compared further. None is the start of another: where types agree
    as well, both end at the same place.
    """
    lengths = np.append(np.diff(lms) + 1, 1)
    bits = (2 * int(s.max()) + 2).bit_length()
    each = max(1, 62 // bits)
    rank, left, done = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(left):
        packed = np.zeros(len(left), np.int64)
        for k in range(done, done + each):
            at = np.minimum(lms[left] + k, len(s) - 1)
            packed = packed << bits | np.where(k < lengths[left], 2 * s[at] + small[at] + 1, 0)
        order = np.lexsort((packed, rank[left]))
        left, packed = left[order], packed[order]
        group, here = rank[left], np.arange(len(left))
        other = np.append(True, group[1:] != group[:-1])
        new = other | np.append(True, packed[1:] != packed[:-1])
        first = np.maximum.accumulate(np.where(new, here, 0))
        rank[left] = group + first - np.maximum.accumulate(np.where(other, here, 0))
        alone = new & np.append(new[1:], True)
        done += each
        left = left[~alone & (lengths[left] > done)]
    seen = np.zeros(len(lms), np.int64)
    seen[rank] = 1
    dense = np.cumsum(seen) - 1
    return dense[rank], int(dense[-1]) + 1


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of integers below `size`; the last one must be 0 and the only 0."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # Leftmost-smaller substrings in order, named, and the string of their names sorted in turn.
    if size > WIDEST:
        names, count = named_by_symbols(s, small, lms)
    else:
        sa = induce(s, small, lms, size)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        place = np.empty(len(s), np.int64)
        place[lms] = np.arange(len(lms))
        lengths = np.append(np.diff(lms) + 1, 1)
        names_in_order = np.cumsum(~_same_as_before(s, ordered, lengths[place[ordered]])) - 1
        names = np.empty(len(lms), np.int64)
        names[place[ordered]] = names_in_order
        count = int(names_in_order[-1]) + 1
    if count < len(lms):
        ordered = lms[sorted_names(names, count)]
    else:
        ordered = np.empty(len(lms), np.int64)
        ordered[names] = lms
    return (induce if size <= WIDEST else induce_each)(s, small, ordered, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the common prefix of each suffix with its predecessor and with its successor in the array.

    Symbol 0 equals nothing. Where the symbols before both suffixes agree the value is one less than at the position
    before; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    left, right = s[np.maximum(here - 1, 0)], s[np.maximum(before - 1, 0)]
    irreducible = (before < 1) | (here < 1) | (left != right) | (left == 0)
    at = np.flatnonzero(irreducible & (before >= 0))
    length = np.zeros(n, np.int64)
    step = 0
    while len(at):
        a, b = at + step, before[at] + step
        fits = (a < n) & (b < n)
        at, a, b = at[fits], a[fits], b[fits]
        at = at[(s[a] == s[b]) & (s[a] != 0)]
        step += 1
        length[at] = step
    start = np.maximum.accumulate(np.where(irreducible, here, 0))
    with_before = np.maximum(length[start] - (here - start), 0)
    after = np.zeros(n, np.int64)
    after[sa[:-1]] = with_before[sa[1:]]
    return with_before, after


def repeated_starts(pieces: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each piece, whether the string of `least` bytes at each start occurs at another place of the shard."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces])
    s = np.zeros(lengths.sum() + len(pieces) + 1, np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(s), bool)
    inside[begins + lengths] = False
    inside[-1] = False
    s[inside] = np.concatenate(pieces).astype(np.int64) + 2
    s[begins + lengths] = 1
    sa = suffix_array(s, 258)
    s[s == 1] = 0
    with_before, after = permuted_prefixes(s, sa)
    found = np.maximum(with_before, after) >= least
    return [found[b:b + max(0, n - least + 1)] for b, n in zip(begins, lengths)]
