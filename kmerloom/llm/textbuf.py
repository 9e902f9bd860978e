"""Vectorised word tables over the raw UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All of the work is
done on whole buffers with numpy, so no Python object is made for a word.
Memory is bounded by ``CHUNK`` bytes of text (or by one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BYTE_CODES = np.random.default_rng(20240611).integers(1, 2**64 - 1, 256, dtype=_U) | _U(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    factors = np.full(size, base, _U)
                    factors[0] = 1
                    setattr(self, name, np.cumprod(factors, dtype=_U))
        return self.up, self.down


_BYTE_POWERS = _Powers(_BYTE_BASE)
_WORD_POWERS = _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _rolling(codes: np.ndarray, powers: _Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[start:end] for every pair, independent of the position."""
    up, down = powers.upto(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of texts: first row, last row + 1, their bytes and their offsets."""
    buf, offs = string_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per text the number of its first word (n + 1 bounds)."""
    inside = ~_SPACE[buf]
    full = offs[1:] > offs[:-1]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, so all characters beyond ASCII, stay."""
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _rolling(_BYTE_CODES[buf], _BYTE_POWERS, starts, ends)


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Hash of the word sequence that starts at each of ``first`` and has ``width`` words."""
    return _rolling(hashes, _WORD_POWERS, first, first + width)


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words at which ``width`` words of one text start, and the text of each."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    n = np.maximum(counts - width + 1, 0)
    base = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return np.arange(len(doc)) + base, doc
