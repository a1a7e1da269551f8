"""Vectorised views of Arrow string columns: words, their hashes, windows.

Everything works on the UTF-8 bytes of a whole batch at once, so a text costs a
few numpy passes and no Python object per word.  Words are maximal runs of
bytes other than space and TAB..CR, which for UTF-8 equals the same rule on
code points.  A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word bytes: everything but space and 0x09..0x0D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Hashes of ranges are polynomials modulo this prime: modulo a power of two some strings agree under every base.
PRIME = (1 << 61) - 1
_BASES = (0x1E3779B97F4A7C15, 0x02B2AE3D27D4EB4F)
_P, _LOW31, _LOW30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base modulo PRIME, and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, PRIME)):
            p = np.ones(1, U64)
            while len(p) < size:
                p = np.concatenate((p, product(p, np.full(1, pow(base, len(p), PRIME), U64))))
            out.append(p)
        _powers[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def range_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each pair of bounds; equal contents have equal hashes wherever they stand.

    Symbols are bytes, or 64-bit hashes that count modulo PRIME.
    """
    n = len(symbols)
    p, inverse = powers(max(n, 1), which)
    high, low = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
    if symbols.dtype == np.uint8 and n < 1 << 22:  # products and their sums fit without a reduction
        own = symbols.astype(U64) + U64(1)
        np.cumsum(own * (p[:n] >> U64(31)), out=high[1:])
        np.cumsum(own * (p[:n] & _LOW31), out=low[1:])
    else:
        own = symbols.astype(U64) + U64(1) if symbols.dtype == np.uint8 else reduced(symbols)
        term = product(own, p[:n])
        np.cumsum(term >> U64(31), out=high[1:])
        np.cumsum(term & _LOW31, out=low[1:])
    at = np.minimum(start, max(n - 1, 0))
    total = reduced(product(reduced(high[end] - high[start]), np.full(1, 1 << 31, U64)) + reduced(low[end] - low[start]))
    return mix(product(total, inverse[at]) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def digests(data: bytes | memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 digest of data[start:end] for each pair of bounds: no two contents are made to agree by their form."""
    out, blake = bytearray(), hashlib.blake2b
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        out += blake(data[a:b], digest_size=8).digest()
    return np.frombuffer(bytes(out), U64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts, joined, and the offsets of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``most`` bytes each (a longer text stands alone); bounds memory, drops nothing."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of all words, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_byte[data]
    starts_here, ends_here = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts_here[cut] = inside[1:-1][cut]
    ends_here[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return range_hashes(LOWER[data] if lower else data, starts, ends)


def owners(first: np.ndarray) -> np.ndarray:
    """The text each word belongs to, from the first-word index of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive symbols, regardless of text bounds (len(symbols)-k+1 of them)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    factor = 1
    for j in range(k):
        total += symbols[j : j + n] * U64(factor)
        factor = factor * (_BASES[1] | 1) % (1 << 64)
    return mix(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return m[:n] if have == w else np.minimum(m[:n], m[w - have : w - have + n])


#: Low bits of a hash that ``sliding_argmin`` gives up for the index.
INDEX_BITS = 24


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each w consecutive hashes, by doubling; the lowest INDEX_BITS bits of a hash don't count."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step, mask = 1 << INDEX_BITS, U64((1 << INDEX_BITS) - 1)
    out = np.empty(n, np.int64)
    for low in range(0, n, step - w):  # so many at a time that each index fits into its bits
        part = x[low : min(low + step - w, n) + w - 1]
        least = sliding_min((part & ~mask) | np.arange(len(part), dtype=U64), w)
        out[low : low + len(least)] = (least & mask).astype(np.int64) + low
    return out


def windows_inside(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the symbols at which a window of ``width`` symbols of one text starts; first: index of each text's first symbol."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(total)
