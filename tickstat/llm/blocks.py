"""Vectorised words and word n-grams over Arrow string columns.

Tasks read documents as Arrow batches. A batch is cut into blocks of whole
rows with a bounded number of bytes (a longer text is a block of its own), and
a block is handled as one byte array: word limits come from a byte table, and
every word gets a 64-bit polynomial hash from one prefix sum. Null texts count
as empty. Words never cross a row limit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(is_word) -> np.ndarray:
    """Byte -> lower-cased byte for word bytes, 0 for separators."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if is_word(b):
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Words are runs of ASCII letters, ASCII digits and non-ASCII characters.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
#: Words are runs of anything but the space and the controls 9 to 13. The NUL
#: byte is a word byte; it takes the code 255, which UTF-8 never uses.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
SPACED[0] = 255


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back, or nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the machine: worker processes outlive their
    tasks, and would hold what one stage freed beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, with freed memory given back before and after a task."""
    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return task


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span, in order of start; codes are byte codes."""
    if len(codes) > BLOCK_BYTES and len(start) > 1:  # in parts, so that the tables of powers stay small
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right")))
            base = start[i]
            out[i:j] = span_hashes(codes[base : end[j - 1]], start[i:j] - base, end[i:j] - base)
            i = j
        return out
    up, down = _powers(BLOCK_BYTES if len(codes) <= BLOCK_BYTES else 1 << int(len(codes)).bit_length())
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUES[codes] * up[: len(codes)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row in block, hash, start byte, end byte) of every word of the rows
    lo..hi, in order; the bytes count from the start of the block."""
    base = int(offsets[lo])
    codes = table[data[base : int(offsets[hi])]]
    limits = offsets[lo : hi + 1] - base
    is_word = codes != 0
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    inner = limits[1:-1]
    at = inner[inner < len(codes)]
    first[at] = is_word[at]
    at = inner[inner > 0]
    last[at - 1] = is_word[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(limits, start, side="right") - 1
    return row, span_hashes(codes, start, end), start, end


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _VALUES[3 * j + 1]
    return mix(out + np.uint64(k))


def row_limits(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's words: words of row r are [limits[r], limits[r + 1])."""
    return np.searchsorted(row, np.arange(rows + 1))
