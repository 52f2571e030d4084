"""Monotone sequences in Elias-Fano form and an n-gram trie of them, in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
#: Place of the k-th one (from the low end) of a byte.
_ONE_AT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _ONE_AT[_b, :len(_places)] = _places

WIDEST_LOW = 56
CHUNK = 1 << 16
_U = np.uint64


class Mapped:
    """Arrays in one temporary file that goes with its last user."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, array: np.ndarray) -> np.ndarray:
        array = np.ascontiguousarray(array)
        if not array.size:
            return array
        self.file.seek(0, 2)
        at = -(-self.file.tell() // 64) * 64
        self.file.seek(at)
        self.file.write(array.tobytes())
        self.file.flush()
        return np.memmap(self.file, array.dtype, "r", at, array.shape)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, with the number of ones before each 64 bits."""

    def __init__(self, values: np.ndarray, store: Mapped):
        values = np.asarray(values, np.uint64)
        n = self.n = len(values)
        top = int(values[-1]) if n else 0
        self.bits = min(WIDEST_LOW, max(0, (top // max(1, n)).bit_length() - 1))
        self.highest = top >> self.bits
        unary = np.zeros(-(-(n + self.highest + 1) // 64) * 8, np.uint8)
        low = [np.zeros(0, np.uint8)]
        for start in range(0, n, CHUNK):
            part = values[start:start + CHUNK]
            place = (part >> _U(self.bits)).astype(np.int64) + np.arange(start, start + len(part))
            np.bitwise_or.at(unary, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
            if self.bits:
                flags = (part[:, None] >> np.arange(self.bits, dtype=np.uint64)) & _U(1)
                low.append(np.packbits(flags.astype(np.uint8).ravel(), bitorder="little"))
        self.low = store.add(np.concatenate([*low, np.zeros(8, np.uint8)]))
        words = unary.reshape(-1, 8)
        kind = np.uint32 if 8 * len(unary) < 2**32 else np.int64
        ones = np.append(0, np.cumsum(_ONES[words].sum(axis=1)))
        self.unary = store.add(words)
        self.ones = store.add(ones.astype(kind))
        self.zeros = store.add((64 * np.arange(len(ones)) - ones).astype(kind))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the unary part."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word].astype(np.int64)
        octets = self.unary[word] if one else ~self.unary[word]
        seen = np.cumsum(_ONES[octets], axis=1)
        octet = (seen <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest = rest - np.where(octet > 0, seen[row, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _ONE_AT[octets[row, octet], rest]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64) << _U(self.bits)
        if not self.bits:
            return high
        at = i * self.bits
        byte, out = at >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.bits + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << _U(8 * k)
        return high | ((out >> (at & 7).astype(np.uint64)) & _U((1 << self.bits) - 1))

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place in [begin, end) whose value is not below x, else `end`.

        Values with the high part of x stand between two zeros of the unary part; there it is looked up by halving.
        """
        x = x.astype(np.uint64)
        high = (x >> _U(self.bits)).astype(np.int64)
        beyond = high > self.highest
        high = np.minimum(high, self.highest)
        # Zeros close the values of each high part; the last high part is closed by the end of the sequence.
        first = np.zeros(len(x), np.int64)
        later = np.flatnonzero(high > 0)
        first[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        last = np.full(len(x), self.n, np.int64)
        inner = np.flatnonzero(high < self.highest)
        last[inner] = self._select(high[inner], False) - high[inner]
        low, top = np.clip(first, begin, end), np.clip(last, begin, end)
        low[beyond] = top[beyond] = end[beyond]
        while True:
            at = np.flatnonzero(low < top)
            if not len(at):
                return low
            middle = (low[at] + top[at]) >> 1
            less = self.access(middle) < x[at]
            low[at[less]] = middle[less] + 1
            top[at[~less]] = middle[~less]

    def find(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the successor of x in [begin, end), whether its value is x)."""
        at = self.successor(x, begin, end)
        there = at < end
        there[there] = self.access(at[there]) == x[there]
        return at, there


class Trie:
    """Two levels: contexts with a backoff, and per context its followers with a probability, both quantised logarithms.

    A monotone pointer leads from each context to its followers. They are stored on top of the last value of the context
    before, which makes one monotone sequence of all, and are looked up relative to that value within the pointers' range.
    """

    STEP = 1 / 4096

    def __init__(self, context: np.ndarray, follower: np.ndarray, log_p: np.ndarray, backoff: np.ndarray):
        """Pairs in order of (context, follower), without repeats; log10 of each pair's probability, of its context's backoff."""
        store = Mapped()
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(context)))
        last = follower[first + sizes - 1].astype(np.uint64)
        under = np.cumsum(last) - last
        self.contexts = EliasFano(context[first], store)
        self.pointers = EliasFano(np.append(first, len(context)), store)
        self.followers = EliasFano(follower.astype(np.uint64) + np.repeat(under, sizes), store)
        self.p, self.backoff = store.add(self._coded(log_p)), store.add(self._coded(backoff[first]))

    def _coded(self, log: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(-log / self.STEP), 65535).astype(np.uint16)

    def find(self, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known pair, log10 probability of known pairs, log10 backoff of contexts; 0 for unknown ones)."""
        n = len(context)
        known, log_p, backoff = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        at, there = self.contexts.find(context.astype(np.uint64), np.zeros(n, np.int64), np.full(n, self.contexts.n))
        inside, at = np.flatnonzero(there), at[there]
        backoff[inside] = self.backoff[at] * -self.STEP
        begin, end = (self.pointers.access(at + k).astype(np.int64) for k in (0, 1))
        under = np.zeros(len(at), np.uint64)
        later = begin > 0
        under[later] = self.followers.access(begin[later] - 1)
        place, there = self.followers.find(under + follower[inside].astype(np.uint64), begin, end)
        known[inside[there]] = True
        log_p[inside[there]] = self.p[place[there]] * -self.STEP
        return known, log_p, backoff
