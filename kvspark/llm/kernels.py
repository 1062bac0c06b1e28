"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on the raw UTF-8 buffer of an Arrow string column: word
boundaries, word hashes and shingle hashes are numpy expressions over bytes, so
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Texts are handled in slices of about so many bytes, which bounds the scratch arrays.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(maxsize=8)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base & _MASK, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    return _powers(max(16, int(n).bit_length()))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the value each byte adds to a word's hash."""

    is_word: np.ndarray
    value: np.ndarray


@lru_cache(maxsize=8)
def alphabet(breaks: str = "space", lower: bool = False) -> Alphabet:
    """``space``: words are runs without 0x20 and 0x09-0x0D. ``alnum``: words are runs
    of ASCII letters and digits and of all bytes from 0x80 on. ``lower`` folds A-Z."""
    b = np.arange(256)
    if breaks == "space":
        is_word = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    else:
        is_word = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    value = mix(b.astype(U64) * U64(0xD1B54A32D192ED03) + U64(0x632BE59BD9B4E019)) | U64(1)
    if lower:
        value[0x41:0x5B] = value[0x61:0x7B]
    return Alphabet(is_word, value)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 bounds of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, bounds


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some rows: byte starts and ends in ``buf``, hashes, and each row's first word."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray | None = None

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that are longer, and which these are."""
        own = np.flatnonzero(self.ends - self.starts > size)
        if not len(own):
            return np.zeros(0, U64), own
        at = self.starts[own]
        up, _ = powers(len(self.buf) + 1)
        return mix((self.sums[at + size] - self.sums[at]) * up[at] + U64(size)), own

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def words(buf: np.ndarray, bounds: np.ndarray, alpha: Alphabet, sums: np.ndarray | None = None) -> Words:
    """All words of the rows that ``bounds`` cuts out of ``buf``. ``sums``: of another call with the same
    bytes and the same folding, if there was one."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    buf, bounds = buf[lo:hi], bounds - lo
    n = hi - lo
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(bounds), np.int64), np.zeros(0, U64))
    inside = alpha.is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = bounds[:-1]
    before[cut[cut < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = bounds[1:] - 1
    after[cut[cut >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    if sums is None:
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(alpha.value[buf] * down[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * up[starts])
    return Words(buf, starts, ends, np.searchsorted(starts, bounds).astype(np.int64), hashes, sums)


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n] + U64(seed & _MASK)
    for k in range(1, size):
        out = out * U64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles of one text's words; fewer words than ``size`` make one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(size, len(hashes)), len(hashes) if len(hashes) < size else 0))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def scale(x: np.ndarray, n: int) -> np.ndarray:
    """Maps 64-bit hashes evenly onto 0..n-1 by their upper halves."""
    return ((x >> U64(32)) * U64(n)) >> U64(32)
