"""Vectorised word handling over Arrow string columns.

A batch of texts is held as one byte array plus document offsets; words, word
hashes and shingle hashes of all its documents are computed by array operations,
without a Python loop over words. Everything here is deterministic, so any task
can be run again on another executor with the same result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in slices of about this many bytes, which bounds the memory of a task.
SLICE_BYTES = 3_000_000

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = ~_SEP
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z were lower-cased.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_LONG = 64
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its freed memory back to the system when a task ends: worker processes stay for later tasks, and those of several kinds of task stay beside each other."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


class Texts:
    """Texts of one slice: bytes (8 zero bytes follow them) and offsets. A null text has no bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1


def as_large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of 64-bit offsets, so that its bytes may pass 2 GB."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()) if column.type != pa.large_string() else column


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) over the column in slices of about ``most`` bytes; a single longer text makes a slice alone."""
    column = as_large(column)
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(column))
        own = np.zeros(off[j] - off[i] + 8, np.uint8)
        own[:-8] = data[off[i] : off[j]]
        yield i, j, Texts(own, off[i : j + 1] - off[i])
        i = j


def words(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word index of each document plus the total) of the runs of bytes that ``table`` marks."""
    n = t.off[-1]
    m = table[t.data[:n]]
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], nxt[:-1] = m[:-1], m[1:]
    prev[t.off[:-1][t.off[:-1] < n]] = False
    ends_at = t.off[1:] - 1
    nxt[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(m & ~prev)
    ends = np.flatnonzero(m & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, t.off)


def lanes(data: np.ndarray) -> np.ndarray:
    """For each byte position the 8 bytes from it as a little-endian integer; the last 8 positions are left out."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    n, at = (ends - starts), lanes(data)
    h = n.astype(np.uint64) * _MUL + np.uint64(seed)
    h = mix(h ^ (at[starts] & _MASK[np.minimum(n, 8)]))
    left = np.flatnonzero((n > 8) & (n <= _LONG))
    k = 8
    while len(left):
        h[left] = mix((h[left] * _MUL) ^ (at[starts[left] + k] & _MASK[np.minimum(n[left] - k, 8)]))
        k += 8
        left = left[n[left] > k]
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def run_hashes(h: np.ndarray, k: int, mul: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes (of the array; the caller masks runs over a document's end)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = h[:n].copy(), np.uint64(mul | 1)
    for j in range(1, k):
        out *= m
        out += h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Marks the word indexes from which k consecutive words lie in one document."""
    n = first[-1]
    ok = np.ones(max(0, n - k + 1), bool)
    for j in range(1, k):  # the last k - 1 words of each document
        last = first[1:] - j
        ok[last[(last >= first[:-1]) & (last < len(ok))]] = False
    return ok


def joined(t: Texts, table: np.ndarray, lower: bool) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts rewritten as their words joined by one space, with word starts, ends and first word indexes in them."""
    if lower:
        t = Texts(LOWER[t.data], t.off)
    starts, ends, first = words(t, table)
    n = t.off[-1]
    data = t.data[:n]
    m = table[data]
    keep = m.copy()
    glue = ends[:-1] if len(ends) else ends  # a space after each word but a document's last
    last = np.zeros(len(ends), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    glue = ends[~last]
    keep[glue] = True
    body = np.where(m, data, np.uint8(0x20))[keep]
    own = np.zeros(len(body) + 8, np.uint8)
    own[:-8] = body
    length = ends - starts
    step = length + ~last
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(step, out=at[1:])
    return Texts(own, at[first]), at[:-1], at[:-1] + length, first


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 (public specification) of data[start:end] for all pairs, vectorised over the ranges of equal length."""
    n = ends - starts
    out = np.zeros(len(n), np.uint64)
    if not len(n):
        return out
    at = lanes(data)
    order = np.argsort(n.astype(np.uint16) if n.max() < 65536 else n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order])) + 1
    s0 = np.uint64(seed)
    with np.errstate(over="ignore"):
        for own in np.split(order, cuts):
            size = int(n[own[0]])
            if len(own) < 4 or size > 512:
                for i in own:
                    out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
                continue
            p, k = starts[own], 0
            if size >= 32:
                v = [np.full(len(own), x, np.uint64) for x in (s0 + _P1 + _P2, s0 + _P2, s0, s0 - _P1)]
                while size - k >= 32:
                    v = [_round(x, at[p + (k + 8 * j)]) for j, x in enumerate(v)]
                    k += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
            else:
                h = np.full(len(own), s0 + _P5, np.uint64)
            h = h + np.uint64(size)
            while size - k >= 8:
                h = _rotl(h ^ _round(np.uint64(0), at[p + k]), 27) * _P1 + _P4
                k += 8
            if size - k >= 4:
                h = _rotl(h ^ ((at[p + k] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                k += 4
            while size > k:
                h = _rotl(h ^ (data[p + k].astype(np.uint64) * _P5), 11) * _P1
                k += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[own] = h ^ (h >> np.uint64(32))
    return out
