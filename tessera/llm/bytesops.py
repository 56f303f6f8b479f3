"""Vectorised byte kernels: slices of texts, word spans and polynomial hashes.

All kernels work on the UTF-8 bytes of many texts laid end to end, with
``bounds`` (n + 1 ascending offsets) telling the texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .frames import large_text

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_2
    return h ^ (h >> np.uint64(33))


class SpanHasher:
    """64-bit hashes of byte spans [start, end) of one buffer; equal bytes hash alike in every buffer.

    Unequal spans can hash alike (a polynomial modulo 2**64 has such pairs whatever its base): compare the
    bytes (``same_spans``) where it matters.
    """

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE_VALUE):
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[buf] * _power_table(_BASE, n), out=self.sums[1:])
        self.inverse = _power_table(_BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length * _LENGTH_FACTOR)


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for consecutive rows of at most ``limit`` bytes (one row at least)."""
    texts = large_text(column)
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, whole[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    return t


def word_byte_table() -> np.ndarray:
    """Which bytes belong to a word: 0-9, A-Z, a-z and every byte of a non-ASCII character."""
    t = np.zeros(256, dtype=bool)
    t[ord("0"):ord("9") + 1] = True
    t[ord("A"):ord("Z") + 1] = True
    t[ord("a"):ord("z") + 1] = True
    t[128:] = True
    return t


LOWER = lower_table()
WORD_BYTE = word_byte_table()


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (n + 1 values)."""
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:n + 1] = WORD_BYTE[buf]
    opens = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < n)]
    cut = cut[inside[cut] & inside[cut + 1]]
    opens[cut] = True
    closes[cut] = True
    starts = np.flatnonzero(opens[:n + 1])
    ends = np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, lower-cased (A-Z only)."""
    return SpanHasher(buf, _BYTE_VALUE[LOWER])(starts, ends)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position of a buffer on, as one number."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded.data, strides=(1,))


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``at_a`` in ``a`` equal those from ``at_b`` in ``b``."""
    eights_a = _eights(a)
    eights_b = eights_a if b is a else _eights(b)
    same, rest, k = np.ones(len(length), dtype=bool), np.arange(len(length)), 0
    while len(rest):
        left = length[rest] - k
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        differs = (eights_a[at_a[rest] + k] ^ eights_b[at_b[rest] + k]) & mask
        same[rest[(differs != 0) & (left > 0)]] = False
        rest, k = rest[left > 8], k + 8
    return same


def repeat_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and which range each came from."""
    size = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), size)
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) - first[which] + lo[which], which


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Boolean of length n: positions inside any [lo, hi)."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps[:n]) > 0
