"""A compact bigram trie: Elias-Fano levels with quantised smoothed probabilities.

Level one holds the context ids and, as monotone pointers, where each context's successors begin;
level two holds successor ids, each context's list shifted by the context's place times the id space,
so that the whole level is one monotone sequence.  A query finds its context, follows the pointers
and searches the successor relative to that context.  All levels are one block of bytes that can be
memory-mapped; nothing is unpacked before it is used.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Codes of probabilities: 0 for absent, else 1 + round(-log10(p) / STEP).
STEP = 1 / 256


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in steps of STEP decades; 0 stays 0 (absent)."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP)
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype("<u2")


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) * STEP), 0.0)


class Bits:
    """64-bit words with ranks of ones before each word; select by search and halving."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray):
        self.words, self.ranks = words, ranks

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the ``k``-th (from 0) one, or zero."""
        place = np.arange(len(self.words), dtype=np.int64) * 64
        before = self.ranks if ones else place - self.ranks
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.int64)
        bits = self.words[word] if ones else ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            right = left >= count
            left = np.where(right, left - count, left)
            at = np.where(right, at + width, at)
            bits = np.where(right, bits >> np.uint64(width), part)
        return word * 64 + at


class EliasFano:
    """A non-decreasing sequence of numbers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """Parts to store: header, packed low bits, unary high bits, ranks."""
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(int(universe) // max(n, 1), 1).bit_length() - 1
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(universe) >> low_bits) + 2
        words = np.zeros(-(-size // 64), "<u8")
        at = high + np.arange(n)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ranks = np.zeros(len(words), "<i8")
        ranks[1:] = np.cumsum(np.bitwise_count(words))[:-1]
        packed = np.zeros(-(-n * low_bits // 64) + 1, "<u8")
        if low_bits:
            low = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            shift = (bit & 63).astype(np.uint64)
            np.bitwise_or.at(packed, bit >> 6, low << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(packed, (bit[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        return [np.array([n, low_bits], "<i8"), packed, words, ranks]

    @classmethod
    def opened(cls, parts: list[np.ndarray]) -> "EliasFano":
        head, low, words, ranks = (p.view("<u8") for p in parts)
        return cls(int(head[0]), int(head[1]), low, Bits(words, ranks.view("<i8")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)),
                        np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self.high.select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (``n`` if there is none)."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self.high.select(high, False) - high
        # Binary search among the elements with the same high part.
        while True:
            open_ = begin < end
            if not open_.any():
                return begin
            middle = (begin + end) >> 1
            less = np.zeros(len(values), bool)
            less[open_] = self._low(middle[open_]) < low[open_]
            begin = np.where(open_ & less, middle + 1, begin)
            end = np.where(open_ & ~less, middle, end)


class Trie:
    """Contexts, pointers, successors, and codes of both levels, over one block of bytes."""

    def __init__(self, block):
        raw = np.frombuffer(block, np.uint8)
        head = raw[:8 * 12].view("<u8")
        self.universe, ends = int(head[0]), np.cumsum(head[1:12]).astype(np.int64).tolist()
        parts = [raw[96 + a:96 + b] for a, b in zip([0, *ends], ends)]
        self.contexts = EliasFano.opened(parts[0:4])
        self.pointers = EliasFano.opened(parts[4:8])
        body = parts[8]
        self.backoff = parts[9].view("<u2")
        self.codes = parts[10].view("<u2")
        sizes = body[:32].view("<u8").astype(np.int64)
        cut = np.cumsum(sizes).tolist()
        self.successors = EliasFano.opened([body[32 + a:32 + b] for a, b in zip([0, *cut], cut)])

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, probability: np.ndarray,
              backoff: np.ndarray, universe: int) -> bytes:
        """Bytes of a trie.  Pairs are sorted by (context, word) and distinct; ``backoff`` has one
        value per distinct context, in order."""
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else \
            np.zeros(0, bool)
        begin = np.flatnonzero(new)
        place = np.cumsum(new) - 1
        shifted = place.astype(np.uint64) * np.uint64(universe) + word.astype(np.uint64)
        level = EliasFano.encode(shifted, universe * (len(begin) + 1))
        body = np.concatenate([np.array([p.nbytes for p in level], "<u8").view(np.uint8),
                               *(p.view(np.uint8) for p in level)])
        codes = [quantise(backoff), quantise(probability)]
        parts = [*EliasFano.encode(context[begin], universe),
                 *EliasFano.encode(np.append(begin, len(context)), len(context) + 1), body,
                 *(np.resize(c, -(-len(c) // 4) * 4) if len(c) else np.zeros(4, "<u2")
                   for c in codes)]
        head = np.array([universe, *(p.nbytes for p in parts)], "<u8")
        return head.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def mapped(cls, data: bytes) -> "Trie":
        """The trie over a memory-mapped file that vanishes when it is no longer used."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if it is unknown."""
        if not self.contexts.n or not len(ids):
            return np.full(len(ids), -1, np.int64)
        at = self.contexts.successor(ids)
        known = at < self.contexts.n
        known[known] = self.contexts.get(at[known]) == ids[known].astype(np.uint64)
        return np.where(known, at, -1)

    def successor(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of words after the contexts at ``place``; 0 where unknown."""
        out = np.zeros(len(place), "<u2")
        some = np.flatnonzero(place >= 0)
        if not len(some):
            return out
        begin, end = self.pointers.get(place[some]), self.pointers.get(place[some] + 1)
        value = place[some].astype(np.uint64) * np.uint64(self.universe) \
            + word[some].astype(np.uint64)
        at = self.successors.successor(value).astype(np.uint64)
        inside = (at >= begin) & (at < end)
        found = at[inside].astype(np.int64)
        exact = self.successors.get(found) == value[inside]
        out[some[np.flatnonzero(inside)[exact]]] = self.codes[found[exact]]
        return out
