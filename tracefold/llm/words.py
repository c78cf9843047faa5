"""Vectorised words, hashes and shingles over the UTF-8 bytes of Arrow text columns.

A batch is cut into pieces of whole texts of about ``PIECE`` bytes; a text longer than
that is a piece of its own.  Every step is a numpy pass over the bytes of a piece, so no
Python loop runs per word.  Words are maximal runs of bytes other than space and
tab..carriage return; A-Z is lowered, other letters are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18  # a pass over a piece holds up to about a hundred times as many bytes
U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, PIECE + 1), _PRIME if kind == "up" else _INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=U)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser with two xor-shift multiplications)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive whole texts."""
    data, offsets = as_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with run hash(i, j) = (c[j] - c[i]) * inverse**i."""
    c = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", len(data)), out=c[1:])
    return c


def run_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte run; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    return mix((c[ends] - c[starts]) * _power("down", len(c))[starts] + (ends - starts).astype(U))


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind (``kinds`` per byte) that do not cross texts."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    full = kinds[edges[:-1]] != 0
    return edges[:-1][full], edges[1:][full]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word number per text (one more than texts) of all words."""
    starts, ends = runs(data, offsets, (~SPACE[data]).view(np.uint8))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the first word number per text."""
    starts, ends, first = words(data, offsets)
    return run_hashes(prefix_hashes(LOWER[data]), starts, ends), first


_STEP = U(0xD6E8FEB86659FD93)


def join_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total = total * _STEP + h[j : j + n]
    return mix(total + U(k))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Shingle hashes of each text in order; a text with fewer words has its whole sequence."""
    joined = join_hashes(h, k)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            found.append(joined[a : b - k + 1])
        elif b > a:
            found.append(join_hashes(h[a:b], b - a))
        else:
            found.append(joined[:0])
    return found
