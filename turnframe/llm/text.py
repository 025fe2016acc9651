"""Numpy helpers for whole Arrow batches of texts (run inside Spark tasks).

A batch's texts are one byte buffer with offsets.  ``Words`` finds the words
of all of them at once and gives every word a 64-bit hash, so operators on
word windows work on integer arrays instead of on Python strings.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15

# Bytes that are not word characters of [^\x20\x09-\x0D]+.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
# Bytes that are word characters of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (texts are lower-cased first).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers; changes ``x`` in place."""
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - (off[0] if len(off) else 0)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(batches, text_at: int, target: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that one piece has about ``target``
    bytes of text (a longer text is a piece of its own, never cut).  Before
    and after the worker gives freed memory back: it lives on for other
    stages."""
    keep_little()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(size.astype(np.int64))
        start = 0
        while start < len(at):
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + target, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def worker_cache(name: str) -> dict:
    """A dictionary of this Python process that its later tasks find again
    (task functions come with module variables of their own)."""
    return sys.__dict__.setdefault("_turnframe_cache", {}).setdefault(name, {})


def keep_little() -> None:
    """Lets this Python worker return large buffers to the system as soon as
    they are freed: Arrow takes them from the C library, which maps those of
    a megabyte and more one by one, where it can."""
    settings = worker_cache("memory")
    if "set" not in settings:
        settings["set"] = True
        pa.set_memory_pool(pa.system_memory_pool())
        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
        if mallopt is not None:
            mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which then stays as it is
            mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    give_back()


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library
    can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """All words of a batch: ``starts``, ``ends`` (byte positions in
    ``buf``) and ``first`` (words of document i: first[i] to first[i+1])."""

    def __init__(self, col: pa.Array, kind: np.ndarray = PLAIN, lower: bool = False):
        buf, self.offsets = buffer_of(col)
        self.buf = buf = LOWER[buf] if lower else buf
        self.n_docs = len(self.offsets) - 1
        inside = kind[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        del begins
        stops = inside
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes, the same in every batch."""
        length = self.ends - self.starts
        out = (length.astype(U64) + U64(1)) * U64(_GOLD)
        if not len(length):
            return out
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[:len(self.buf)] = self.buf
        eight = np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))
        short = np.flatnonzero(length <= 64)
        at, left, k = self.starts[short], length[short], 0
        while len(short):
            x = eight[at]
            part = left < 8
            x[part] &= (U64(1) << (left[part].astype(U64) * U64(8))) - U64(1)
            out[short] = mix(out[short] ^ mix(x + U64(k)))
            more = left > 8
            short, at, left, k = short[more], at[more] + 8, left[more] - 8, k + 1
        for i in np.flatnonzero(length > 64):
            out[i] = xxhash.xxh3_64_intdigest(self.buf[self.starts[i]:self.ends[i]].tobytes(), seed=1)
        return out

    def strings(self) -> list[bytes]:
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions whose k words
    pass the array's end are left out; document ends are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(_GOLD * k & 0xFFFFFFFFFFFFFFFF))
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[j:j + n]
        out ^= out >> U64(32)
    return mix(out)


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """True at each word position from which k words stay in its document."""
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    has = counts >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - k + 1, -1)
    return np.cumsum(ok[:total]) > 0


def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``edges`` (empty spans give 0)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def cover(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """True at every word that a window of k words from ``starts`` covers."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, total), -1)
    return np.cumsum(d[:total]) > 0
