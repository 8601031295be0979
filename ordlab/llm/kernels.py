"""Numpy kernels over Arrow text columns: byte slices, rolling hashes, word shingles.

Texts are handled as UTF-8 bytes.  A null text is an empty text.  Every kernel
works on slices of whole documents of about ``SLICE_BYTES`` so that temporary
arrays stay small; a document longer than that is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for ``i < n`` (grown on demand)."""
    if len(_powers[0]) < n:
        size = max(n, 4096)
        for k, b in enumerate((_BASE, _INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield ``(first_row, buf, off)`` for runs of whole texts; ``off`` starts at 0."""
    buf, off = text_arrays(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial byte hash; see ``span_hash``."""
    pw, _ = powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE_HASH[buf] * pw[:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``[start, end)``, independent of where they stand."""
    _, inv = powers(len(c))
    return mix((c[end] - c[start]) * inv[start])


#: a prime and two random bases: unlike a polynomial modulo 2**64, no structured text
#: (such as a Thue-Morse word) collides with another
_PRIME = (1 << 31) - 1
_BASES = [int(_rng.integers(1 << 20, _PRIME)) for _ in range(2)]
_VALUES = _rng.integers(1, _PRIME, 256, dtype=np.uint64)
_place = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(j: int, n: int) -> np.ndarray:
    """``base**i`` modulo the prime for ``i < n`` (grown on demand, by doubling)."""
    a = _place[j]
    while len(a) < n:
        a = np.concatenate((a, a * U(pow(_BASES[j], len(a), _PRIME)) % U(_PRIME)))
    _place[j] = a
    return a


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all bytes of the spans, one after another."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def byte_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hash of the bytes of each span (none is empty), independent of where they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    if start[0] == 0 and end[-1] == len(buf) and (start[1:] == end[:-1]).all():
        value = _VALUES[buf]  # the spans are the whole buffer
    else:
        value = _VALUES[buf[spans(start, size)]]
    place = (np.arange(len(value), dtype=np.int64) - np.repeat(first, size))
    out = []
    for j in range(2):
        x = value * _powers_of(j, int(size.max()))[place]
        x = (x & U(_PRIME)) + (x >> U(31))  # less than 2**32 and the same modulo 2**31 - 1
        out.append(np.add.reduceat(x, first) % U(_PRIME))
    return mix(mix(out[0] << U(31) | out[1]) + size.astype(np.uint64))


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the minimum in every window of ``w`` values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    val, pos, width = h, np.arange(len(h), dtype=np.int32), 1
    while width * 2 <= w:
        a, b = val[:-width], val[width:]
        right = b < a
        pos = np.where(right, pos[width:], pos[:-width])
        val = np.where(right, b, a)
        width *= 2
    d = w - width
    if d:
        a, b = val[:n], val[d:d + n]
        pos = np.where(b < a, pos[d:d + n], pos[:n])
    return pos[:n]


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word: runs without ASCII white space, A-Z lower-cased."""
    low = LOWER[buf]
    gap = SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    word = ~gap
    start = np.flatnonzero(word & (np.concatenate(([True], gap[:-1])) | edge[:-1])) if len(low) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (np.concatenate((gap[1:], [True])) | edge[1:])) + 1 if len(low) else start
    return byte_hash(low, start, end), np.searchsorted(off, start, "right") - 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int):
    """Sorted distinct hashes of the ``k``-word shingles of each text; a text
    with fewer words gives its whole sequence as one, a text without words none."""
    h, doc = word_hashes(buf, off)
    n_docs = len(off) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    s = np.full(max(len(h) - k + 1, 0), U(k))
    for j in range(k):
        s = mix(s * U(0x9FB21C651E98DF25) + h[j:j + len(s)])
    empty = np.zeros(0, np.uint64)
    for i in range(n_docs):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(s[a:b - k + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for j in range(a, b):
                x = mix(x * U(0x9FB21C651E98DF25) + h[j:j + 1])
            yield x
        else:
            yield empty
