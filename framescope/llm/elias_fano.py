"""Rising whole numbers in few bits (Elias-Fano), searched without being unpacked, and trie levels made of them.

``n`` rising numbers below U take about log2(U / n) + 2 bits each: the low bits are
packed side by side, the high parts are counted in unary in a bit vector, with a running
count of its zeros per word.  All operations take arrays of questions at once.

An image is a run of bytes with its arrays at 8-byte places.  ``opened`` makes views into
it and copies nothing, so an image can be a memory-mapped file or a task's buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)


def _packed(values: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Values OR-ed into 64-bit words at rising bit places; a value may run into the next word."""
    out = np.zeros(words + 1, np.uint64)
    if len(values):
        word, shift = (places >> 6).astype(np.int64), (places & 63).astype(np.uint64)
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[begins]] |= np.bitwise_or.reduceat(values << shift, begins)
        out[word[begins] + 1] |= np.bitwise_or.reduceat((values >> _ONE) >> (np.uint64(63) - shift), begins)
    return out


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number ``rank`` (from 0) in each word."""
    words, rank, place = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        above = rank >= count
        rank -= np.where(above, count, 0)
        place += np.where(above, width, 0)
        words = np.where(above, words >> np.uint64(width), low)
    return place


@dataclass(frozen=True)
class Rising:
    """Rising numbers (equal ones allowed) below 2^64."""

    count: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    zeros: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Rising:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = min(62, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
        parts = (values >> np.uint64(bits)).astype(np.int64)
        length = n + (top >> bits) + 2
        low = _packed(values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits, (n * bits + 63) // 64 + 1)
        high = _packed(np.ones(n, np.uint64), parts + np.arange(n), (length + 63) // 64)
        return cls(n, bits, low, high, cls._zeros(high))

    @staticmethod
    def _zeros(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)

    def _low(self, at: np.ndarray) -> np.ndarray:
        place = at.astype(np.int64) * self.bits
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        found = (self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - shift))
        return found & np.uint64((1 << self.bits) - 1)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``part``."""
        zero = part.astype(np.int64) - 1
        inside = np.clip(zero, 0, int(self.zeros[-1]) - 1)
        word = np.searchsorted(self.zeros, inside.astype(np.uint32), "right") - 1
        place = word * 64 + _select(~self.high[word], inside - self.zeros[word])
        return np.where(zero < 0, 0, np.minimum(np.where(zero > inside, self.count, place - inside), self.count))

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, at, "right") - 1
        place = word * 64 + _select(self.high[word], at - ones[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.bits)) | self._low(at)

    def find(self, values: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The first place in [begin, end) of each value, -1 where it is not there: the bucket of its high part, then its successor by low bits."""
        values = np.asarray(values, np.uint64)
        part = np.minimum(values >> np.uint64(self.bits), np.uint64(1 << 62)).astype(np.int64)
        first = np.maximum(self._before(part), begin)
        last = np.minimum(self._before(part + 1), self.count if end is None else end)
        low, stop = values & np.uint64((1 << self.bits) - 1), last.copy()
        active = np.flatnonzero(first < last)
        while len(active):
            middle = (first[active] + last[active]) >> 1
            less = self._low(middle) < low[active]
            first[active] = np.where(less, middle + 1, first[active])
            last[active] = np.where(less, last[active], middle)
            active = active[first[active] < last[active]]
        found = np.full(len(values), -1, np.int64)
        there = np.flatnonzero(first < stop)
        hit = there[self._low(first[there]) == low[there]]
        found[hit] = first[hit]
        return found

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.count, self.bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> Rising:
        head, low, high, zeros = arrays
        return cls(int(head[0]), int(head[1]), low, high, zeros)


_KINDS = [np.dtype(t) for t in ("<i8", "<u8", "<u4", "<u2")]


def image(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (_KINDS.index(a.dtype), len(a)))], "<i8")
    parts = [head.tobytes()]
    for a in arrays:
        raw = a.tobytes()
        parts += [raw, bytes(-len(raw) % 8)]
    return b"".join(parts)


def views(buffer) -> list[np.ndarray]:
    """The arrays of an image, as views into it."""
    many = int(np.frombuffer(buffer, "<i8", 1)[0])
    head, place, out = np.frombuffer(buffer, "<i8", 2 * many, 8), 8 * (1 + 2 * many), []
    for kind, length in head.reshape(-1, 2):
        out.append(np.frombuffer(buffer, _KINDS[kind], length, place))
        place += -(-out[-1].nbytes // 8) * 8
    return out


@dataclass(frozen=True)
class Level:
    """One level of an n-gram trie, or a slice of it: contexts, pointers to their successors, the successors, and a number for each."""

    contexts: Rising
    pointers: Rising
    successors: Rising
    of_context: np.ndarray
    of_successor: np.ndarray

    @classmethod
    def of(cls, contexts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, of_context: np.ndarray, of_successor: np.ndarray) -> Level:
        """From distinct rising contexts, how many successors each has, and their 32-bit codes, rising within a context.

        Successors are kept as one rising run: a context's number times 2^32 is added to its codes.
        """
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return cls(Rising.of(contexts), Rising.of(ends), Rising.of((owner << np.uint64(32)) | codes), of_context.astype(np.uint16), of_successor.astype(np.uint16))

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """The number of each context, -1 for unknown ones."""
        return self.contexts.find(contexts)

    def successor(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The place of each code among the successors of its context, -1 where context or code is unknown."""
        known = np.flatnonzero(numbers >= 0)
        out = np.full(len(numbers), -1, np.int64)
        if len(known):
            own, which = np.unique(numbers[known], return_inverse=True)
            begin, end = self.pointers.get(own).astype(np.int64), self.pointers.get(own + 1).astype(np.int64)
            values = (numbers[known].astype(np.uint64) << np.uint64(32)) | codes[known].astype(np.uint64)
            out[known] = self.successors.find(values, begin[which], end[which])
        return out

    def image(self) -> bytes:
        return image([*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.of_context, self.of_successor])

    @classmethod
    def opened(cls, buffer) -> Level:
        a = views(buffer)
        return cls(Rising.from_arrays(a[:4]), Rising.from_arrays(a[4:8]), Rising.from_arrays(a[8:12]), a[12], a[13])
