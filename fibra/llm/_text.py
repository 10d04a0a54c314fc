"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time, inside a Spark task: Spark decides how the
rows are split and shuffled, numpy only touches the bytes of the rows it was handed.  No function
loops over rows or words in Python, so cost is a few nanoseconds for each byte of text.

Nulls count as empty texts.  A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that one numpy step handles; a single longer text is handled alone.
PIECE_BYTES = 1 << 20
#: Rows that a piece holds at most, so that a row number fits above a 52-bit value in one word.
PIECE_ROWS = 1 << 12

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII case folding, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = _RNG.integers(1, 2**63, 64, dtype=U64) | U64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the life of the worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the n + 1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that cover every row once, of at most ``limit`` bytes or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + PIECE_ROWS)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never run across rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[:-1]
    cuts = cuts[cuts < len(buf)]
    first[cuts] = inside[cuts]
    ends = offs[1:]
    ends = ends[ends > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their rows, in order, repeats included.

    A row with words, but fewer than ``k``, has one shingle: its whole sequence.
    """
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_row = np.repeat(np.arange(rows), count)
    at = np.arange(len(out_row)) - np.repeat(np.cumsum(count) - count, count) + first[out_row]
    size = np.minimum(n, k)[out_row]
    total = size.astype(U64)
    padded = np.concatenate((words, np.zeros(k, U64)))
    for i in range(k):
        part = padded[at + i] * _ODD[i]
        if i:
            part[size <= i] = 0
        total = total + part
    return mix(total), out_row


def distinct_by_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit values of each row, sorted within the row; rows stay in order.

    Values lose their upper 12 bits.  There may be ``PIECE_ROWS`` rows at most.
    """
    low = U64((1 << 52) - 1)
    both = np.sort((row.astype(U64) << U64(52)) | (values & low))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return both & low, (both >> U64(52)).astype(np.int64)


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from values grouped by row."""
    offs = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values).cast(kind))
