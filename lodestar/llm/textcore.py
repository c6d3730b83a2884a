"""Vectorised word splitting and hashing over Arrow string buffers.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. A word's hash is a polynomial over 2**64 of a
random table of its bytes, finished with a bijective mixer, taken from running sums over the whole
batch, so that no Python string is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = U(0x9E3779B97F4A7C15)  # odd, 5 modulo 8
_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes handled at once; a longer document is handled whole.
CHUNK = 1 << 21
_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Let the system have the memory that a worker has freed, which its allocators would keep while it waits or works on other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def giving_back(f: Callable) -> Callable:
    """``f`` of a key and one or two tables (Spark counts the arguments), after which its worker's free memory is given back."""

    def of(*args):
        try:
            return f(*args)
        finally:
            give_back()

    if f.__code__.co_argcount == 2:
        return lambda key, group: of(key, group)
    return lambda key, left, right: of(key, left, right)


def returning(f: Callable) -> Callable:
    """``f`` of batches, after which its worker's free memory is given back."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return of


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n, from a cache that grows by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 65536) if have is None else max(n, 2 * len(have))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with avalanche."""
    x = np.bitwise_xor(x, x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and n+1 offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if off is not None and off.size else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of every word; a document's edge ends a word, as do bytes marked in ``between``."""
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(between[data], out=solid[1:-1])
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[1:-1][inner]
    ends[inner - 1] |= solid[1:-1][inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def running(data: np.ndarray, lower: bool) -> np.ndarray:
    """Running sums over bytes, from which :func:`hash_sums` takes the hash of any span."""
    n = len(data)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[data] * powers(_MUL, n), out=run[1:])
    return run


def hash_sums(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (run[end] - run[start]) * powers(_INV, len(run))[start]
    return mix(h + (end - start).astype(np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    return hash_sums(running(data, lower), start, end)


def words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and n+1 word offsets of the documents."""
    start, end = spans(data, offs)
    return hash_spans(data, start, end, lower), np.searchsorted(start, offs)


def rolling(h: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of k consecutive words (len(h) - k + 1 of them), edges of documents ignored."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    base = U(seed | 5) if seed & 2 == 0 else U(seed)
    inv = U(pow(int(base), -1, 2**64))
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(h * powers(base, n), out=run[1:])
    return mix((run[k:] - run[:-k]) * powers(inv, n)[: n - k + 1])


def split_groups(col: pa.Array, lower: bool, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, word hashes, word offsets) for runs of documents of a column."""
    data, offs = buffers(col)
    for lo, hi in groups(offs, size):
        part = offs[lo : hi + 1]
        h, w = words(data[part[0] : part[-1]], part - part[0], lower)
        yield lo, hi, h, w


def within(w: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a run of k words lies inside one document."""
    n = int(w[-1])
    if n < k:
        return np.zeros(0, np.int64)
    left = np.repeat(w[1:], np.diff(w)) - np.arange(n)
    return np.flatnonzero(left[: n - k + 1] >= k)
