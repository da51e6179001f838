"""64-bit hashes of the words and word shingles of whole texts, computed on Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(1, 2**63 - 1, 256).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _RNG.randint(1, 2**63 - 1, 8).astype(U64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER_BYTE = _BYTE[_LOWER]
#: Bytes of text that are hashed at once; a longer text stands alone.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class _Powers:
    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = U64(pow(self.base, len(self.have), 2**64))
            self.have = np.concatenate([self.have, self.have * step])
        return self.have[:n]


_POW, _INV = _Powers(_BASE), _Powers(_BASE_INV)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end, first)``: a hash and byte range per word, and where each row's words begin.

    A word is a run of bytes outside ``gaps`` (``\\x20 \\x09-\\x0D`` unless given); A-Z count as a-z when ``lower``.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none, np.zeros(len(off), dtype=np.int64)
    inside = ~gaps[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[raw] * _POW.upto(n), out=total[1:])
    h = mix((total[end] - total[start]) * _INV.upto(n)[start])
    return h, start, end, np.searchsorted(start, off).astype(np.int64)


def shingle_sets(column: pa.Array, size: int = 5):
    """Yield, row by row, the sorted distinct shingle hashes (uint64) of each text.

    A text of fewer than ``size`` words has its whole sequence as the one shingle; one without words has none.
    """
    raw, off = text_buffers(column)
    for a, b in chunks(off):
        h, _, _, first = words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        run = np.zeros(max(0, len(h) - size + 1), dtype=U64)
        for j in range(size):
            run += h[j : j + len(run)] * _PLACE[j]
        run = mix(run)
        for k in range(b - a):
            lo, hi = first[k], first[k + 1]
            if hi - lo >= size:
                x = np.sort(run[lo : hi - size + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif hi > lo:
                # the length is part of the hash, so a short text never meets a full shingle
                yield mix(np.array([(h[lo:hi] * _PLACE[: hi - lo]).sum(dtype=U64) ^ U64(0xA5A5 + hi - lo)], dtype=U64))
            else:
                yield h[:0]
