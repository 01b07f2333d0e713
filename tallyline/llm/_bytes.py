"""Vectorised primitives over the bytes of Arrow string columns: words, hashes, windows, winnowing.

A batch's texts stand one after another in one buffer; every function works on all of them at once, so the cost is a
few array passes a byte and no Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random digits for the 256 byte values.
DIGITS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a word that are hashed by numpy; a longer word goes to BLAKE2.
LONG = 64


def byte_class(members: str | bytes | range | list[int], inverse: bool = False) -> np.ndarray:
    """A table of 256 flags, 1 for the members."""
    t = np.zeros(256, np.uint8)
    t[[ord(c) if isinstance(c, str) else c for c in members]] = 1
    return 1 - t if inverse else t


#: Of [^\x20\x09-\x0D]; bytes above 0x7F only occur inside other characters.
NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)], inverse=True)
#: Of [^\x00-\x2F\x3A-\x60\x7B-\x7F], and a table that lower-cases A-Z first.
LOWER_ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of at most `limit` bytes, or one row. Null: empty."""
    for first, arr in _chunks(column):
        if arr.null_count:
            arr = arr.fill_null("")
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        _, off, data = arr.buffers()
        n = len(arr)
        if not n:
            continue
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield first + a, first + b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    if not isinstance(column, pa.ChunkedArray):
        yield 0, column
        return
    at = 0
    for c in column.chunks:
        yield at, c
        at += len(c)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix, so that all bits depend on all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order. The shift after each product keeps it from being a polynomial in its inputs."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += b
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros beyond the end."""
    return np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each [start, end): their length and blocks of eight, mixed in turn; BLAKE2 for long ones."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(h):
        return h
    eight = blocks(buf)
    short = size <= LONG
    live, most = np.flatnonzero(short), int(size[short].max(initial=0))
    for j in range(0, most, 8):
        live = live[size[live] > j]
        x = eight[starts[live] + j]
        left = np.minimum(size[live] - j, 8).astype(np.uint64)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        h[live] = mixed(joined(h[live], x))
    raw = memoryview(buf)
    for i in np.flatnonzero(~short).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def windows(digits: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of a few digits, each joined in turn."""
    n = len(digits) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mixed(digits[:n] + np.uint64(k))
    for j in range(1, k):
        h = joined(h, digits[j : j + n])
    return h


def spans(digits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of runs of a few digits; equal to those of windows() of the same size."""
    h = mixed(digits[starts] + sizes.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    for j in range(1, int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > j)
        h[live] = joined(h[live], digits[starts[live] + j])
    return h


def wide_windows(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k bytes or digits: those of two windows half as long or more, and so on down."""
    if len(buf) < k:
        return np.zeros(0, np.uint64)
    if buf.dtype == np.uint8 and k >= 8:
        w, h = 8, mixed(blocks(buf)[: len(buf) - 7])
    else:
        w, h = 1, mixed(DIGITS[buf] if buf.dtype == np.uint8 else buf)
    while w < k:
        step = min(w, k - w)
        h = joined(h[: len(h) - step], h[step:])
        w += step
    return mixed(h)


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes that stay within a text; offsets of texts in the list of words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = np.zeros(len(buf) + 2, np.uint8)
    m[1:-1] = member[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    here = m[1:] != m[:-1]
    starts = np.flatnonzero((here | edge)[:-1] & (m[1:-1] == 1))
    ends = np.flatnonzero((here | edge)[1:] & (m[1:-1] == 1)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each window of w; log2(w) passes."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Indices of hashes that are the least of some window of w valid hashes; windows with an invalid one don't count.

    Equal windows choose the same places, so sequences that share a whole window share a chosen hash.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    whole = sliding(valid, w, np.logical_and)
    least = np.where(whole, sliding(h, w, np.minimum), 0)
    pad = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero(valid & (most == h) & (most > 0))


def within(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Flags of the windows of k that stay inside one text, for a sequence of n with texts at offsets."""
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n - k + 1, bool)
    inner = offsets[1:-1]
    bad = ragged(np.maximum(inner - k + 1, 0), np.minimum(inner, n - k + 1) - np.maximum(inner - k + 1, 0))
    ok[bad[bad < len(ok)]] = False
    return ok


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the n places that a window of `length` from one of starts covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
