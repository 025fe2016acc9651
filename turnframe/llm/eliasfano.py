"""Elias-Fano sequences and a two-level n-gram trie on one buffer."""

from __future__ import annotations

import numpy as np

from .text import U64


def _low_bytes(n: int, universe: int) -> int:
    """Whole bytes for the low part of n values below ``universe``."""
    bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    return -(-bits // 8)


class EliasFano:
    """A non-decreasing sequence: low bytes as they are, high parts as a
    bit vector with a one for every value and a zero for every step."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low_part, self.high = n, low_bytes, low, high
        self._decoded: tuple | None = None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = values.astype("<u8")
        n, b = len(values), _low_bytes(len(values), universe)
        low = values.view(np.uint8).reshape(n, 8)[:, :b].copy() if n else np.zeros((0, b), np.uint8)
        top = (values >> U64(8 * b)) if b < 8 else np.zeros(n, U64)
        steps = int(universe - 1 >> (8 * b)) + 1 if universe > 0 else 1
        bits = np.zeros(n + steps, np.uint8)
        bits[top.astype(np.int64) + np.arange(n)] = 1
        return cls(n, b, low.reshape(-1), np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bytes, len(self.high)], "<i8").tobytes()
        return head + self.low_part.tobytes() + self.high.tobytes()

    @classmethod
    def view(cls, buf, at: int = 0) -> tuple["EliasFano", int]:
        """The sequence at a place of a buffer (no copy) and the place after."""
        n, b, size = np.frombuffer(buf, "<i8", 3, at).tolist()
        low = np.frombuffer(buf, np.uint8, n * b, at + 24)
        high = np.frombuffer(buf, np.uint8, size, at + 24 + n * b)
        return cls(n, b, low, high), at + 24 + n * b + size

    def _directory(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each value's one, number of values before each step's
        end) in the bit vector; the low parts stay packed."""
        if self._decoded is None:
            bits = np.unpackbits(self.high, bitorder="little")
            kind = np.int32 if len(bits) < 1 << 31 else np.int64
            zeros = np.flatnonzero(bits == 0)
            self._decoded = np.flatnonzero(bits)[:self.n].astype(kind), (zeros - np.arange(len(zeros))).astype(kind)
        return self._decoded

    def _low(self, at: np.ndarray) -> np.ndarray:
        """The low parts of the values at some places."""
        out = np.zeros((len(at), 8), np.uint8)
        out[:, :self.low_bytes] = self.low_part.reshape(self.n, self.low_bytes)[at]
        return out.reshape(-1).view("<u8")

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        ones, _ = self._directory()
        top = (ones[at] - at).astype(U64)
        return (top << U64(8 * self.low_bytes)) | self._low(at) if self.low_bytes < 8 else self._low(at)

    def values(self) -> np.ndarray:
        return self.access(np.arange(self.n))

    def find(self, queries: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each query among strictly increasing values, between its
        ``lo`` and ``hi`` if they are given, or -1 if it is not there: the
        successor search within the step of its high part."""
        _, before = self._directory()
        queries = queries.astype(U64)
        shift = 8 * self.low_bytes
        top = (queries >> U64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(queries), np.int64)
        want = queries & U64((1 << shift) - 1) if shift < 64 else queries
        inside = top < len(before)
        t = np.where(inside, top, 0)
        at = np.where(t > 0, before[np.maximum(t - 1, 0)], 0).astype(np.int64)
        limit = np.where(inside, np.minimum(before[t], self.n), 0).astype(np.int64)
        if lo is not None:
            at, limit = np.maximum(at, lo), np.minimum(limit, hi)
        end = np.maximum(limit, at)
        # halve every query's span until the first value that is not smaller
        while len(open_ := np.flatnonzero(at < end)):
            mid = (at[open_] + end[open_]) // 2
            less = self._low(mid) < want[open_]
            end[open_] = np.where(less, end[open_], mid)
            at[open_] = np.where(less, mid + 1, at[open_])
        hit = inside & (at < limit)
        hit[hit] = self._low(at[hit]) == want[hit]
        return np.where(hit, at, -1)


class NgramTrie:
    """Words, and under each word the words that stood before it.

    Level 1: word codes (Elias-Fano), quantised logarithms and the monotone
    pointers (Elias-Fano) to the words' spans of level 2.  Level 2: the codes
    of the words before, relative to the word they stand under: a word's codes
    begin after the last value of the span before it, which makes the level one
    increasing sequence (Elias-Fano) without the words in it; and quantised
    logarithms.  A pair is found through its word's two pointers, by successor
    search in that span alone.  All levels lie one after the other in one
    buffer and are read in place.
    """

    CODE_BITS = 32

    def __init__(self, buf):
        self.words, at = EliasFano.view(buf)
        self.pointers, at = EliasFano.view(buf, at)
        self.before, at = EliasFano.view(buf, at)
        n1, n2 = self.words.n, self.before.n
        self.word_value = np.frombuffer(buf, "<u2", n1, at)
        self.pair_value = np.frombuffer(buf, "<u2", n2, at + 2 * n1)

    @classmethod
    def build(cls, words: np.ndarray, word_bits: int, word_value: np.ndarray, parent: np.ndarray, code: np.ndarray,
              pair_value: np.ndarray) -> bytes:
        """Rows of level 2 (parent: index of the word, code) are sorted."""
        n = len(words)
        counts = np.bincount(parent, minlength=n) if n else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        last = np.zeros(n, U64)
        held = counts > 0
        if held.any():
            last[held] = code.astype(U64)[ends[1:][held] - 1] + U64(1)
        begin = np.concatenate([np.zeros(1, U64), np.cumsum(last, dtype=U64)])  # what the spans before take
        relative = begin[parent] + code.astype(U64)
        return b"".join([EliasFano.encode(words, 1 << word_bits).to_bytes(),
                         EliasFano.encode(ends, len(code) + 1).to_bytes(),
                         EliasFano.encode(relative, int(begin[-1]) + 1).to_bytes(),
                         word_value.astype("<u2").tobytes(), pair_value.astype("<u2").tobytes()])

    @classmethod
    def open(cls, path: str) -> "NgramTrie":
        """A trie file, memory-mapped."""
        return cls(np.memmap(path, np.uint8, "r"))

    def find_words(self, codes: np.ndarray) -> np.ndarray:
        return self.words.find(codes)

    def find_pairs(self, word: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Index in level 2 of ``code`` under each word index, or -1."""
        out = np.full(len(word), -1)
        known = np.flatnonzero(word >= 0)
        if not self.before.n or not len(known):
            return out
        lo, hi = (self.pointers.access(word[known] + k).astype(np.int64) for k in (0, 1))
        begin = np.where(lo > 0, self.before.access(np.maximum(lo - 1, 0)) + U64(1), U64(0))
        out[known] = self.before.find(begin + code[known].astype(U64), lo, hi)
        return out

    def span(self, word: int) -> tuple[int, int]:
        """Where a word's level 2 begins and ends."""
        a, b = self.pointers.access(np.array([word, word + 1])).tolist()
        return a, b
