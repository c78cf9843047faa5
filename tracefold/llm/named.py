"""Words by dictionary code, and 128-bit digests of distinct words.

Words of a piece are numbered by Arrow's dictionary encoding, so two words have one code only
if their bytes are equal.  Digests are taken once per distinct word: up to 16 bytes are mixed as
two integers that hold the whole word, longer words go through BLAKE2b.  Word sequences
can be told apart by combinations of these random-looking values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tracefold.llm.words import SPACE, U, mix, words

SHORT = 16


def named_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word, the distinct words by code, and the first word number per text (and their number)."""
    starts, ends, first = words(data, offsets)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = np.ascontiguousarray(data[~SPACE[data]])
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
    ).dictionary_encode()
    return column.indices.to_numpy(), column.dictionary, first


_KEYS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def lanes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each distinct word (a large_binary array)."""
    n = len(names)
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + n + 1]
    letters = names.buffers()[2]
    data = np.concatenate([np.frombuffer(letters, np.uint8) if letters is not None else np.zeros(0, np.uint8), np.zeros(SHORT, np.uint8)])
    size = np.diff(offsets)
    place = np.arange(SHORT)
    cut = data[offsets[:-1, None] + place]
    cut[place >= size[:, None]] = 0
    a, b = cut.reshape(n, 2, 8).view(U)[:, :, 0].T
    one = mix(mix(a + _KEYS[0] + size.astype(U) * _KEYS[4]) ^ (b * _KEYS[1] + _KEYS[2]))
    two = mix(mix(b + _KEYS[3]) ^ (a * _KEYS[4] + size.astype(U) * _KEYS[2]))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        joined = b"".join(hashlib.blake2b(names[i].as_py(), digest_size=16).digest() for i in long.tolist())
        pair = np.frombuffer(joined, U).reshape(-1, 2)
        one[long], two[long] = pair[:, 0], pair[:, 1]
    return one, two
