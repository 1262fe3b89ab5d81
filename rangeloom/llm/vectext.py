"""Vectorised byte-level views of a column of texts: words, lines, code points, 64-bit hashes.

All texts of a piece lie in one buffer. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; as those are ASCII, byte runs are the same as code-point runs in UTF-8.
Whatever takes more than a few bytes for each byte of text is done in blocks of ``BLOCK`` bytes, so a text of any length
needs its own bytes, four masks of the same length, and a fixed number of bytes a word.

Span hashes are polynomials modulo 2**64 of random byte codes, then mixed. Equal bytes give equal hashes. Chance collisions of
n spans have odds of n**2 / 2**65; a writer who knows the base can construct spans of thousands of bytes that collide,
which would make them count as equal.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M = (1 << 64) - 1
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(256, dtype=U) + U(0x51ED27))
BYTE_LOWER = BYTE[LOWER]
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of one step of work that needs many bytes for each.
BLOCK = 1 << 20


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..size of the base and of its inverse."""
    out = []
    for b in (BASE, BASE_INV):
        x = np.full(size + 1, b, U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets into them. The column has no nulls."""
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    off = np.frombuffer(offs, kind, n + 1, col.offset * kind.itemsize).astype(np.int64) if offs else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept bytes that stay in one text, and the
    len + 1 offsets of each text's runs."""
    n = len(keep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cut = off[(off > 0) & (off < n)]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    first[cut] = keep[cut]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    last[cut - 1] = keep[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, block: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever the span lies. Spans ascend and don't overlap."""
    block = block or BLOCK
    power, inverse = _powers(block)
    codes = BYTE_LOWER if lower else BYTE
    out = np.zeros(len(starts), U)
    total = np.zeros(min(block, len(raw)) + 1, U)
    first, open_span = 0, -1  # the span that began in an earlier block and goes on
    for a in range(0, len(raw), block):
        b = min(a + block, len(raw))
        np.cumsum(codes[raw[a:b]] * power[: b - a], out=total[1 : b - a + 1])
        if open_span >= 0:
            stop = min(int(ends[open_span]), b)
            shift = pow(BASE, a - int(starts[open_span]), 1 << 64)
            out[open_span] = U(int(out[open_span]) + int(total[stop - a]) * shift & _M)
            if ends[open_span] <= b:
                open_span = -1
        last = int(np.searchsorted(starts, b))
        if last > first:
            s, e = starts[first:last] - a, np.minimum(ends[first:last], b) - a
            out[first:last] = (total[e] - total[s]) * inverse[s]
            if ends[last - 1] > b:
                open_span = last - 1
            first = last
    return mix(out + mix((ends - starts).astype(U)))


def span_counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """How many bytes of each span the mask marks. Spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.int64)
    for k in range(0, len(starts), step):
        s, e = starts[k : k + step], ends[k : k + step]
        a = int(s[0])
        total = np.zeros(int(e[-1]) - a + 1, np.int32)
        np.cumsum(mask[a : int(e[-1])], out=total[1:], dtype=np.int32)
        out[k : k + step] = total[e - a] - total[s - a]
    return out


def code_points(raw: np.ndarray, off: np.ndarray, more: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, the text of each, how many of them are this block's own) of one block after another; a block also shows
    the ``more`` code points behind it."""
    n = len(raw)
    a = 0
    while a < n:
        b = _edge(raw, min(a + BLOCK, n))
        e = b
        for _ in range(more):
            e = _edge(raw, min(e + 1, n))
        points = np.frombuffer(raw[a:e].tobytes().decode().encode("utf-32-le"), "<u4")
        at = np.flatnonzero((raw[a:e] & 0xC0) != 0x80) + a
        own = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(at, off)))
        yield points, own, int(np.searchsorted(at, b))
        a = b


def _edge(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a code point begins, or the end."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def owners(off: np.ndarray) -> np.ndarray:
    """The text of each run."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


class Words:
    """Words of each text of a column: ``starts``, ``ends``, ``off`` (runs of each text)."""

    def __init__(self, col: pa.Array):
        self.raw, self.text_off = buffers(col)
        self.sep = SEP[self.raw]
        self.starts, self.ends, self.off = runs(~self.sep, self.text_off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends, lower)

    def owners(self) -> np.ndarray:
        return owners(self.off)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each text's values, by offsets; 0 for none."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
